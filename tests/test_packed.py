import random

from cairn.operators.packed import DELIMITERS, atoms, find_delimiters, split_packed

NAMES = ["Drama", "Sea Epic", "Stop/Start", "War, Home", "So \"Odd\" It Is", "Kids' Hour", "Noir", "Spy", "Road", "Heist"]


def quoted(name, rng):
    if any(c in name for c in ",") or rng.random() < 0.2:
        return '"' + name.replace('"', '""') + '"' if rng.random() < 0.7 or "'" in name else f"'{name}'"
    return f"'{name}'" if '"' in name else name


def test_learnt_from_the_column(spark, rows):
    """A bare slash only ever stands inside a value; every other delimiter separates, and quotes hold theirs."""
    rng = random.Random(5)
    data, want = [], []
    for pos in range(400):
        values = rng.sample(NAMES, rng.randint(1, 4))
        sep = rng.choice(["|", ", ", ";", " / ", "\t", ",", "||", " | "])
        field = rng.choice(["", " ", sep.strip(" ") or ""]) + sep.join(quoted(v, rng) for v in values) + rng.choice(["", " ", sep])
        data.append((pos, field))
        want += [(pos, i, v) for i, v in enumerate(values, 1)]
    df = spark.createDataFrame(data, "id int, f string")
    assert rows(split_packed(df, "id", "f")) == sorted(want)


def test_atoms_of_odd_fields():
    assert [a[2] or a[3] for a in atoms('"a|b"|c')] == ["a|b", ""]
    assert atoms("|;, ") == [] and atoms('""|x')[0][:2] == (3, 4)
    assert len(atoms('"never closed|x')) == 2
    assert [a[2] for a in atoms("'Kids' Hour'")] == ["Kids' Hour"]
    assert [a[2] for a in atoms('"So ""Bad"" It Works"; x')] == ['So "Bad" It Works', None]


def test_edge_cases(spark, rows):
    kind = "id int, f string, field string, value int"
    data = [(1, None, "x", 1), (2, "", "x", 1), (3, " | ", "x", 1), (4, "a", None, None), (4, "a", None, None), (None, "a|b", "y", 2)]
    found = rows(split_packed(spark.createDataFrame(data, kind), "id", "f"))
    assert found == [(4, 1, "a"), (4, 1, "a"), (None, 1, "a"), (None, 2, "b")]
    assert rows(split_packed(spark.createDataFrame([], kind), "id", "f")) == []


def test_very_long_field(spark):
    df = spark.createDataFrame([(1, "|".join(["a", "b"] * 2000)), (2, "a|b"), (3, "b"), (4, "a")], "id int, f string")
    assert split_packed(df, "id", "f").where("id = 1").count() == 4000


def mixed(rng, names, joints, n=600):
    """Fields of values joined by any of ``joints``; the values they hold."""
    data, want = [], []
    for pos in range(n):
        values = rng.sample(names, rng.randint(1, 4))
        data.append((pos, rng.choice(joints).join(values)))
        want += [(pos, i, v) for i, v in enumerate(values, 1)]
    return data, sorted(want)


def test_values_of_many_parts(spark, rows):
    """Values of five and of eight atoms, whose parts never stand alone, among plain ones."""
    data, want = mixed(random.Random(7), ["A/B/C/D/E", "a/b/c/d/e/f/g/h", "Drama", "Spy", "Road", "Heist", "Noir", "Sport"], ["|", ", ", ";"])
    df = spark.createDataFrame(data, "id int, f string")
    assert rows(split_packed(df, "id", "f")) == want
    assert rows(split_packed(df, "id", "f", broadcast_values=0)) == want


def test_delimiters_of_the_column(spark, rows):
    """Blank-dash-blank, ampersand and line break separate; a dash inside a word, a dot and a bracket do not."""
    names = ["Sci-Fi", "Film-Noir", "Drama (old)", "Dr. Who", "Spy", "Road", "Heist", "True-Crime"]
    data, want = mixed(random.Random(8), names, [" - ", "&", "\n", "|"])
    df = spark.createDataFrame(data, "id int, f string")
    assert sorted(find_delimiters(df, "f")) == sorted(DELIMITERS + "-&\n")
    assert rows(split_packed(df, "id", "f")) == want
    assert find_delimiters(spark.createDataFrame([("a-b|c",), ("a-b",), ("d|c",)], "f string"), "f") == DELIMITERS


def test_a_field_that_holds_a_third_of_the_rows(spark, rows):
    data = [(i, "a|b" if i % 3 == 0 else f"a|x{i % 7}") for i in range(300)]
    found = rows(split_packed(spark.createDataFrame(data, "id int, f string"), "id", "f"))
    assert len(found) == 600 and [r[2] for r in found if r[0] == 3] == ["a", "b"]
