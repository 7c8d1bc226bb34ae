"""What the tests of the subpackage share."""

DIR = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASH = {"bucket": 1, "rep": 2, "a": 3, "b": 4, "first": 5, "gram": 6, "near": 7, "spans": 8, "wanted": 9, "key": 10, "part": 11, "cell": 12, "hash": 13, "toxic": 14, "quality": 15, "code": 16, "near_duplicate_id": 17, "seq_id": 18, "vector": 19, "block": 20, "rank": 21, "dim": 22, "group": 23}


LONG = "word " * 60_000
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (None, "no id " * 30), (5, LONG), (6, "!!! ???"), (7, "é" * 5000), (8, "ok text here"), (8, "ok text here")]
