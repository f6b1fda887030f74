import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ord int, tkey string, id string, size int, marks int, part int, comp string, n_words string, kept string, copies int, links int"


def write(spark, rows, path):
    full = [(d, t, "en", s, len(t or ""), 1, "x", "y", 2, 3, 4, "c", "n", "k", 5, 6) for d, t, s in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS if rows else [])], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    texts = [(0, passage_like(3)), (1, None), (2, ""), (3, "UNO uno Öl x"), (3, passage_like(3))] if rows else []
    spark.createDataFrame([(*r, 1, "y", 2) for r in texts], "item_id long, text string, doc_id int, bucket string, s int").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(*r, 1, "e", "v") for r in (edge_vectors() if rows else [])], "vec_id long, embedding array<float>, label int, error int, entries string, v string").repartition(2).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def passage_like(seed):
    return prose(random.Random(seed), 30)


def edge_vectors():
    """vec_id, embedding, label: nulls, what isn't finite, repeated rows, ties, another length, equal ids."""
    rng = random.Random(11)
    rows = [(i, [rng.choice((-1.0, -0.5, 0.0, 0.25, 0.7511)) for _ in range(10)], i % 3 or None) for i in range(400)]
    rows += [rows[5]] * 3 + [(5, rows[6][1], 1), (None, rows[7][1], 2), (500, rows[8][1], 7)]
    return rows + [(600, None, 1), (601, [], 1), (602, [1.0] * 9 + [None], 1), (603, [1.0] * 9 + [float("nan")], 1), (604, [float("-inf")] + [1.0] * 9, 1), (605, [1.0] * 9, 1)]


URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/x?y#z", "http://example.com/en/x", "http://a.example.com/en/", "http://a.example.com/de/", "http://x.net/es/1", "http://x.net/de/1", "http://com", "http://a.com/", "http://x.org#a/b", "http://notexample.com/en/", "a://b://c/d", "http://cheap-pills.org/en/1", "http://x.org/\nq"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so", "pa", "ne", "vi", "do") for b in ("ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru", "sa", "te")]


def edge_rows():
    """doc_id, text, source: nulls, empty and white texts, ties, repeated rows, copies, near copies, shared
    passages, repeated lines and a very long text."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (5, 30, 60, 200, 400, 900)]
    passage, line = prose(rng, 55), prose(rng, 40)
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(20, None, "s1"), (21, "", None), (22, " \n\t\n", "s2"), (23, "uno", "s0"), (None, base[3], "s3"), (None, None, None)]
    rows += [(30, base[4], "s0")] * 3 + [(31, base[4], "hot"), (31, base[5], "hot")]
    near = base[5].split()
    near[400] = "otra"
    rows += [(40 + i, " ".join(near[: 900 - i]), "hot") for i in range(12)]
    rows += [(60 + i, f"{prose(rng, 30)}\n{line}\n{line}.\n{prose(rng, 10)} {passage} {prose(rng, 9)}\n\n{line}", "hot") for i in range(15)]
    rows += [(80, "Ha ha ha " * 3000, "hot"), (81, prose(rng, 40_000), "hot"), (82, "\n".join(["misma línea aquí"] * 500), "s1"), (83, "x" * 50_000, "s1"), (84, "a<|endoftext|>b <|endoftext|>", "s2")]
    return rows


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    rows = edge_rows()
    return rows, write(spark, rows, tmp_path_factory.mktemp("edge"))


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, [], tmp_path_factory.mktemp("empty"))
