"""Fixed tables: knowledge entries of animals and plants, and demo media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ENTRY = "title string, latin string, tags array<string>, habitat string, features array<string>, note string"

# Key, title, latin, tags, habitat, features, note.
ANIMALS = (
    ("梅花鹿", "梅花鹿", "Cervus nippon", ["哺乳动物", "鹿科", "林缘活动"], "林地、草坡、林缘和开阔灌丛区域。", ["体表白色斑点明显", "四肢细长", "警觉性强"], "当前部署版对内置稳定样本使用演示映射，真实物种结论仍建议结合模型版和人工复核。"),
    ("野猪", "野猪", "Sus scrofa", ["哺乳动物", "偶蹄目", "夜间活动"], "森林、灌丛、农田边缘和山地沟谷。", ["体型粗壮", "吻部突出", "背部轮廓较高"], "适合作为 camera-trap MVP 的稳定演示样本，但真实部署仍需要区域物种库支持。"),
    ("狐狸", "狐狸", "Vulpes", ["哺乳动物", "犬科", "候选分类"], "林缘、草地、荒坡和农田周边。", ["吻部较尖", "尾部蓬松", "行动灵活"], "狐狸类结果建议作为候选展示，后续可用本地物种清单细分到具体种。"),
    ("狼", "狼", "Canis lupus", ["哺乳动物", "犬科", "需复核"], "山地、森林、草原和人类干扰较少区域。", ["体型较大", "吻部较长", "耳部直立"], "狼与犬、狐狸等容易在单帧中混淆，MVP 中建议显示为候选并保留复核口径。"),
    ("Tapirus", "貘属", "Tapirus", ["哺乳动物", "夜行性", "林地湿润环境"], "热带森林、河岸和湿地边缘。", ["体型粗壮", "鼻吻部灵活", "常在夜间活动"], "当前分类器可能输出属级结果，更适合当作候选类别展示。"),
    ("Mazama", "短角鹿属", "Mazama", ["哺乳动物", "鹿科", "林下活动"], "热带和亚热带森林下层，常在隐蔽区域活动。", ["体型较小", "四肢细长", "常单独出现"], "属级结果不能等同于具体物种，需要结合区域物种库判断。"),
    ("Canis", "犬属", "Canis", ["哺乳动物", "食肉目", "候选分类"], "森林、草地、农田边缘等多种环境。", ["吻部较长", "耳形明显", "行动敏捷"], "犬属包含多种动物，MVP 中建议把它展示为候选属类。"),
    ("Unknown", "未知动物", "Unknown", ["低置信度", "类外动物", "待人工复核"], "需要结合地点、时间、连续帧和原图综合判断。", ["模型置信度不足", "可能不在当前分类范围内"], "这是系统的安全出口，避免把不确定结果说成确定物种。"),
)
# Title, latin, tags, habitat, features, note.
PLANTS = (
    ("银杏", "Ginkgo biloba", ["乔木", "扇形叶", "秋季识别"], "城市绿化、山地林缘、栽培环境。", ["扇形叶", "叶脉二叉分叉", "秋季叶色金黄"], "植物识别更依赖叶、花、果和季节信息，当前页面只做知识库预留。"),
    ("马尾松", "Pinus massoniana", ["针叶树", "常绿乔木", "山地"], "丘陵、山地、阳坡和疏林区域。", ["针叶成束", "树皮灰褐色", "球果明显"], "如果画面里只有远景树冠，分类通常不稳定。"),
    ("芒草", "Miscanthus sinensis", ["草本", "禾本科", "林缘"], "林缘、坡地、路旁和开阔草地。", ["线形叶", "大型圆锥花序", "秋季穗状明显"], "草本植物通常需要更近的细节图，适合作为后续采集样本。"),
    ("毛竹", "Phyllostachys edulis", ["竹类", "常绿", "林地"], "山坡、沟谷、竹林和人工栽培区域。", ["竹秆明显", "节间较长", "叶片披针形"], "竹类识别需要看竹秆、枝叶和生长环境，远景很容易只识别为植被。"),
    ("山茶", "Camellia japonica", ["灌木", "常绿", "花期特征"], "山地林缘、园林和湿润半阴环境。", ["叶片革质", "边缘有细锯齿", "花色醒目"], "花期图片更适合展示，非花期需要依赖叶片、枝条和生境信息。"),
    ("杉木", "Cunninghamia lanceolata", ["乔木", "针叶", "人工林"], "山地、人工林、丘陵和常绿林环境。", ["叶片狭长", "树干通直", "枝叶层次分明"], "针叶树在远景里常容易和周边植被混淆，更适合做结构化知识卡展示。"),
)
# Title, label, note, src, file_name.
DEMO_MEDIA = (
    ("梅花鹿", "稳定演示", "主体完整，适合先演示检测框和结果表。", "/demo/deer.jpg?v=2", "demo-deer.jpg"),
    ("野猪", "稳定演示", "体型和轮廓明显，适合作为第二张测试图。", "/demo/boar.jpg?v=2", "demo-boar.jpg"),
    ("狐狸", "补充样本", "背景较复杂，适合说明真实野外场景。", "/demo/fox.jpg?v=2", "demo-fox.jpg"),
    ("狼", "候选识别", "犬科特征明显，但分类结果需保守展示。", "/demo/wolf.jpg?v=2", "demo-wolf.jpg"),
    ("夜间空场景", "对照样本", "用于演示低光或无动物场景。", "/demo/empty_scene.jpg?v=2", "demo-empty-scene.jpg"),
)


def animal_knowledge(spark: SparkSession) -> DataFrame:
    """Entries with their key and priority, 0 first."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(ANIMALS)], f"priority int, key string, {_ENTRY}")


def plant_library(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(PLANTS)], f"priority int, {_ENTRY}")


def demo_media(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(DEMO_MEDIA)], "priority int, title string, label string, note string, src string, file_name string")
