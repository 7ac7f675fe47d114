"""Tables, media and the result store."""
