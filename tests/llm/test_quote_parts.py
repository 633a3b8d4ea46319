"""Partial, short and nested top-posted quotes."""

from fellwalk.llm import quotes


def test_partial_short_and_nested_quotes(spark):
    first = "The first line of Ann.\nThe second line of Ann.\nThe third line of Ann."
    rows = [(1, 0, first), (1, 1, "> The first line of Ann.\n> The third line of Ann.\nBob agrees with two of them."),
            (2, 0, "Paragraph one goes\nover two lines.\n\nParagraph two is here.\n\nParagraph three ends it."), (2, 1, "Something else entirely."),
            (2, 2, "> Paragraph one goes over\n> two lines.\n>\n> Paragraph three ends it.\nFine."),
            (3, 0, "Ann asks a question here."), (3, 1, "Bob answers it like this.\n\nOn Mon, Ann wrote:\n> Ann asks a question here."),
            (3, 2, "Cid adds a thing.\n\nOn Tue, Bob wrote:\n> Bob answers it like this.\n>\n> On Mon, Ann wrote:\n> > Ann asks a question here."),
            (4, 0, "Yes."), (4, 1, "Longer words between."), (4, 2, "> Yes.\nGood."), (5, 0, "No."), (5, 1, "No."), (5, 2, "> No.\nWhy?"),
            (6, 0, "Hello to all of you.\nAlpha is the topic."), (6, 1, "Hello to all of you.\nBeta is the topic.\nMore of it."), (6, 2, "> Hello to all of you.\n> Beta is the topic.\nYes.")]
    t = spark.createDataFrame([(c, k, "user", x) for c, k, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in quotes.conversations(t).collect()}
    want = {(1, 1): 0, (2, 2): 0, (3, 1): 0, (3, 2): 1, (4, 2): 0, (6, 2): 1}
    assert got == {(c, k): want.get((c, k)) for c, k, _ in rows}
