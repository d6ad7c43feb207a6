import random

import pytest

from cairn.llm.truncation import find_truncated, truncation_by_source

NAMES = ["Ada", "Bo", "Cleo", "Dora", "Emil", "Finn", "Greta", "Hugo"]
PATTERNS = ["The {n} of the old harbour was painted by {a} in 19{d}.", "{a} never returned the {n}, which seemed late at the time.", "It took {d} days until the {n} could be opened again.", "Nobody in town knew whether the {n} was closed that same night."]
NOUNS = ["lantern", "bridge", "orchard", "staircase", "poster", "workshop"]
FOOTS = ["Back to top", "Imprint | Privacy | Terms", "Page {d} of 99", "Tags: {n}, {n}", "Who knows…", "© 20{d} {a}net"]


@pytest.fixture(scope="module")
def texts():
    """Whole pages with sentences and often a footer; every fifth is cut in a sentence, at a letter or a word."""
    rng = random.Random(8)
    data = []
    for i in range(3000):
        fill = lambda p: p.format(n=rng.choice(NOUNS), a=rng.choice(NAMES), d=rng.randint(10, 99))
        sentences = [fill(rng.choice(PATTERNS)) for _ in range(rng.randint(3, 8))]
        text, cut = " ".join(sentences), i % 5 == 0
        if cut:
            at = rng.randint(len(text) - len(sentences[-1]) + 4, len(text) - 2)
            text = text[:at] + rng.choice(["", "", "...", " …"])
        elif rng.random() < 0.6:
            text += "\n" + fill(rng.choice(FOOTS))
        data.append((i, "s1" if cut else "s2", text, cut))
    return data


def test_precision_and_recall(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, source string, text string, cut boolean")
    found = find_truncated(df, "doc_id", "text", "source")
    got = {r["doc_id"] for r in found.where("truncated").collect()}
    want = {i for i, _, _, cut in texts if cut}
    assert len(got & want) > 0.95 * len(want) and len(got & want) > 0.95 * len(got)
    shares = {r["source"]: r for r in truncation_by_source(found, "source").collect()}
    assert shares["s1"]["share"] > 0.95 and shares["s2"]["share"] < 0.05 and shares["s1"]["n_texts"] == 600


@pytest.mark.parametrize("frame", ["", "Mirror {i}, kept by host {i}\n"])
def test_copies_do_not_vouch_for_each_other(spark, texts, frame):
    """A third of all rows are one cut page, as it is or in frames of their own: every copy is found, and the rest as without."""
    page = " ".join(["It took 12 days until the bridge could be opened again."] * 6 + ["Nobody in town knew whether the bridge was closed that"])
    data = texts + [(10_000 + i, "s1", frame.format(i=i) + page, True) for i in range(1500)]
    df = spark.createDataFrame(data, "doc_id long, source string, text string, cut boolean")
    got = {r["doc_id"] for r in find_truncated(df, "doc_id", "text").where("truncated").collect()}
    assert all(10_000 + i in got for i in range(1500))
    want = {i for i, _, _, cut in texts if cut}
    rest = {i for i in got if i < 10_000}
    assert len(rest & want) > 0.95 * len(want) and len(rest & want) > 0.95 * len(rest)


def test_footers_shared_by_pages_still_count(spark, texts):
    """The same last lines below other content are no copies."""
    data = [(i, text + "\nLetters, Notes and Maps of the Coast", False) for i, _, text, cut in texts if not cut]
    found = find_truncated(spark.createDataFrame(data, "doc_id long, text string, cut boolean"), "doc_id", "text")
    assert found.where("truncated").count() == 0


def test_edge_cases(spark):
    kind = "id long, text string, source string, gram string, p double, truncated boolean"
    assert find_truncated(spark.createDataFrame([], kind), "id", "text").collect() == []
    data = [(1, None), (2, ""), (3, "  \n"), (4, "word"), (5, "…"), (6, "A b."), (6, "A b."), (None, "A b."), (7, "\u0001 x'\" \\ ퟿ 12,5 %"), (8, "long " * 40_000 + "end.")]
    df = spark.createDataFrame([(i, t, None, None, None, None) for i, t in data], kind)
    found = find_truncated(df, "id", "text")
    assert sorted(r["id"] or 0 for r in found.collect()) == [0, 4, 5, 6, 6, 7, 8]
    assert found.where("p_end IS NULL OR truncated IS NULL OR p_end < 0 OR p_end > 1").count() == 0


def test_runs_share_no_views(spark):
    """Two runs in one session, the first read after the second was planned; no view is left."""
    one = find_truncated(spark.createDataFrame([(1, "One whole sentence. Another whole sent")], "id int, text string"), "id", "text")
    two = find_truncated(spark.createDataFrame([(2, "Quite another text."), (3, "Quite another text.")], "id int, text string"), "id", "text")
    assert [r["id"] for r in one.collect()] == [1] and sorted(r["id"] for r in two.collect()) == [2, 3]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cairn_")]


def test_an_ending_of_many_texts(spark, monkeypatch):
    """A verdict that has several copies reaches every text once."""
    from cairn.llm import truncation

    monkeypatch.setattr(truncation, "SPREAD", 3)
    rows = [(i, f"Page {i} says things.\nHome About") for i in range(20)] + [(50, "Alone it st")]
    found = find_truncated(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()
    assert sorted(r["id"] for r in found) == [*range(20), 50]
