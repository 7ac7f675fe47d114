"""The context-mixing score restated word by word, with dictionaries, for small corpora."""

import math
from collections import Counter, defaultdict

from camtrail.llm import context_mixing as cm

K = cm.CLASSES


def stretch(part, whole):
    p = (part + cm.PRIOR) / (whole + 2 * cm.PRIOR)
    return math.log(p) - math.log1p(-p)


def gate(node, node_class):
    return min(11, int(math.log2(node_class + 1))) * 8 + min(21, int(math.log2(node + 1))) // 3


def tree(counts, first, depth):
    """counts: word to counts by class. Logarithms of words' probabilities under each class."""
    depth = depth if depth is not None else first + (int(math.log2(len(counts))) + 7 if len(counts) > 1 else 0)
    sums = defaultdict(lambda: [0] * (K + 1))
    for w, c in counts.items():
        for bit in range(first, depth + 1):
            node = sums[bit, w >> (64 - bit)]
            for k, x in enumerate([sum(c), *c]):
                node[k] += x
    weights = [defaultdict(lambda: [0.3, 0.7]) for _ in range(K)]
    for _ in range(cm.PASSES):
        for bit in range(first, depth):
            for k in range(K):
                pull, curve = Counter(), Counter()
                for w, c in counts.items():
                    if not c[k]:
                        continue
                    above, below = sums[bit, w >> (64 - bit)], sums[bit + 1, w >> (63 - bit)]
                    g = gate(above[0] - 1, above[k + 1] - 1)
                    s = [stretch(below[i] - 1, above[i] - 1) for i in (0, k + 1)]
                    p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights[k][g], s))))
                    for i in (0, 1):
                        pull[g, i] += c[k] * (1 - p) * s[i]
                        curve[g, i] += c[k] * p * (1 - p) * s[i] ** 2
                for g, i in pull:
                    weights[k][g][i] += 0.3 * max(-1, min(1, pull[g, i] / (curve[g, i] + 5)))
    out = {}
    for w, c in counts.items():
        leaf = sums[depth, w >> (64 - depth)][0] if depth > first else sum(sum(x) for x in counts.values())
        out[w] = [math.log(sum(c) / leaf)] * K
        for bit in range(first, depth):
            above, below = sums[bit, w >> (64 - bit)], sums[bit + 1, w >> (63 - bit)]
            for k in range(K):
                v = weights[k][gate(above[0], above[k + 1])]
                out[w][k] -= math.log1p(math.exp(-(v[0] * stretch(below[0], above[0]) + v[1] * stretch(below[k + 1], above[k + 1]))))
    return out


def scores(tokens, trained, own):
    """tokens: of each text, its end last; trained; own: class of each trained text. log10 of each text's probability."""
    counts, pairs = defaultdict(lambda: [0] * K), Counter()
    for text, learn, k in zip(tokens, trained, own):
        for before, w in zip([tokens[0][-1], *text], text) if learn else ():
            counts[w][k] += 1
            pairs[before, w] += 1
    prefixes = defaultdict(dict)
    for w, c in counts.items():
        prefixes[w >> (64 - cm.TREE_BITS)][w] = c
    top = tree({p << (64 - cm.TREE_BITS): [sum(x) for x in zip(*words.values())] for p, words in prefixes.items()}, 0, cm.TREE_BITS)
    n, once = sum(map(sum, counts.values())), sum(sum(c) == 1 for c in counts.values())
    unknown = min(0.5, (once + 0.5) / (n + 1))
    logs = {}
    for p, words in prefixes.items():
        for w, found in tree(words, cm.TREE_BITS, None).items():
            logs[w] = [-min(65535, math.ceil(-x / cm._STEP)) * cm._STEP + y + math.log(1 - unknown) for x, y in zip(found, top[p << (64 - cm.TREE_BITS)])]
    return [score(text, learn, counts, pairs, logs, math.log(unknown)) for text, learn in zip(tokens, trained)]


def score(text, learn, counts, pairs, logs, unknown):
    end, mine = text[-1], Counter(text) if learn else Counter()
    my_pairs = Counter(zip([end, *text], text)) if learn else Counter()
    times = lambda w: sum(counts[w]) - mine[w] if w in logs else 0
    place = [w if w in logs else None for w in text]
    sums, last, rows = [0.0] * (2 * K), 0.0, []
    so_far, pair_so_far, triple_so_far = Counter(), Counter(), Counter()
    earlier, pair_earlier = [], []
    for t, (w, e) in enumerate(zip(text, place)):
        plain = logs[w] if e is not None else [unknown] * K
        cached = [math.log((1 - cm.CACHE) * math.exp(x) + cm.CACHE * so_far[e] / t) for x in plain] if t else plain
        sums = [a + b for a, b in zip(sums, [*plain, *cached])]
        best = max(sums)
        now = best + math.log(sum(math.exp(x - best) for x in sums) / len(sums))
        pair = (place[t - 1] if t else None, e)
        triple = (previous if t else None, e)
        seen = [times(text[t - 1] if t else end), earlier[t - 1] if t else 0, pair_earlier[t - 1] if t > 1 else 0]
        before = (text[t - 1] if t else end, w)
        hits = [pairs[before] - my_pairs[before], pair_so_far[pair] if t else 0, triple_so_far[triple] if t > 1 else 0]
        rows.append((now - last, seen, hits))
        earlier.append(so_far[e])
        pair_earlier.append(pair_so_far[pair])
        last, previous = now, pair
        so_far[e] += 1
        pair_so_far[pair] += 1
        triple_so_far[triple] += 1
    total, moved = 0.0, [0.0] * (1 + len(cm.HALF_SEEN))
    for low in range(0, len(rows), cm.STEP_WORDS):
        pulls = [0.0] * len(moved)
        for alone, seen, hits in rows[low : low + cm.STEP_WORDS]:
            weight = [math.exp(m) * s for m, s in zip(moved, [1, *(s / (s + h) for s, h in zip(seen, cm.HALF_SEEN))])]
            weight = [x / sum(weight) for x in weight]
            joint = [a * b for a, b in zip(weight, [math.exp(alone), *(h / max(1, s) for h, s in zip(hits, seen))])]
            total += math.log(sum(joint))
            pulls = [x + j / sum(joint) - v for x, j, v in zip(pulls, joint, weight)]
        moved = [max(-8, min(8, m + cm.RATE * x)) for m, x in zip(moved, pulls)]
    return total / math.log(10)
