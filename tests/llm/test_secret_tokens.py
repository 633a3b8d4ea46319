"""Random tokens behind names and inside paths."""

import random

from fellwalk.llm import secrets

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_values_and_parts_of_paths(spark):
    rng = random.Random(3)
    make = lambda n, more="": "A7z" + "".join(rng.choice(LETTERS + more) for _ in range(n - 3))
    long, safe, std, padded = make(32), "-Ab9_" + make(40, "-_"), make(20) + "/" + make(18, "+/"), make(42) + "=="
    cases = [("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "AWS_SECRET_ACCESS_KEY=[SECRET]"),
             ("DB_PWD=x9Kq2LmZ7tRw4VbN8sYp3Hd6", "DB_PWD=[SECRET]"), (f"export DB_PWD={long};", "export DB_PWD=[SECRET];"),
             (f"https://x.org/files/{long}/readme", "https://x.org/files/[SECRET]/readme"), (f"https://x.org/a?sig={long}&b=1", "https://x.org/a?sig=[SECRET]&b=1"),
             (f"KEY={padded} x", "KEY=[SECRET]== x"), (f"session_{long}", "session_[SECRET]"), (f"key {std} x", "key [SECRET] x"), (f"V=({safe[1:]})", "V=([SECRET])"),
             ("https://example.org/outdoors/mountains/trails/overview", None), ("NAME=a_long_name_of_words_with_nothing_random", None)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    assert got == {i: t if want is None else want for i, (t, want) in enumerate(cases)}
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(docs).collect()}
    assert spans[1] == "random:7:31" and spans[9] == ""
