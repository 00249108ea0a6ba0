from __future__ import annotations

from tessera.llm import secrets


def linked(spark, texts):
    df = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [sorted((secrets.KINDS[x.kind], x.start, x.end) for x in r.linked) for r in df.orderBy("doc_id").collect()]


def test_parts_are_whole_and_seen_inside_others(spark):
    token, space, host = "x9" * 200, " " * 30, "db." * 200 + "example.com"
    texts = [
        f"user=bob auth={token}",
        f"user{space}={space}bob pass{space}:{space}hunter22",
        "login=https://db.example.com pass=hunter22",
        f"user=bob pwd=hunter22 https://{host}",
        f"user=bob {'n ' * 150}auth={token}",
    ]
    want = [
        [("identifier", 0, 8), ("weak_secret", 9, 414)],
        [("identifier", 0, 68), ("weak_secret", 69, 142)],
        [("endpoint", 6, 28), ("identifier", 0, 11), ("weak_secret", 29, 42)],
        [("endpoint", 22, 30 + len(host)), ("identifier", 0, 8), ("weak_secret", 9, 21)],
        [],
    ]
    assert linked(spark, texts) == want


def test_long_runs_are_linear(spark):
    texts = ["user" + " " * 200_000 + "x", "user = " * 30_000, "pass=" * 40_000, "jdbc:" * 40_000, "login=user=" * 20_000]
    assert len(linked(spark, texts)) == 5
