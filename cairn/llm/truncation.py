"""Texts cut off before their end, from what words do elsewhere: trigrams inside against trigrams at ends.

A token is a run of letters, a number, or another visible character. Lines, and the sentences in them, begin
with two start marks. All trigrams of all texts are counted, each with how often a line or sentence ends on it.
Texts whose final trigram goes on almost everywhere else, and almost never ends anything, were cut. Headings,
menus, lists and footers end lines all the time, and are whole; so is a last sentence that trails off on
purpose, for others trail off alike. A mark set after the cut ("…", "...") is taken off first.

The share of ends of a trigram is smoothed by that of wider classes: the trigram with numbers and capitalised
words made alike, then its last two tokens, then the last one. Wherever a longer word that begins with the last
one stands in its place, that counts as going on: so a word cut inside is told from a whole one. The last of
the short lines (headings, menus) is also counted as a whole line of 3 to 6 tokens, from its start.

All of it is SQL. Trigrams are counted in partial sums before the shuffle; the wider classes are sums over
the distinct trigrams. Copies say nothing new: trigrams are counted over distinct texts, and of texts that differ but end
on the same TAIL characters, as a page cut and mirrored in another frame, only one end counts. That one end is
taken out of the counts a text is judged by, and each copy gets the verdict.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import settle

#: Weight of the wider class, in occurrences; of the trigram beside whole lines.
PRIOR, LINE_PRIOR = 30.0, 10.0
#: A final trigram that ends lines and sentences in a smaller share of cases was cut.
ENDS = 0.15
#: Texts that agree in so many last characters have one end: longer than footers, which pages of other content share.
TAIL = 300
#: Texts of one ending that share one copy of its verdict.
SPREAD = 65_536

_MARKS = r"(?:\\s*(?:…|\\.{3,}|â€¦|\\[\\.\\.\\.\\]))+\\s*$"
#: What every mark of _MARKS holds: texts without any need no search for them.
_HAS_MARK = " OR ".join(f"contains(x, '{m}')" for m in ("…", "...", "â€¦"))


def _unmarked(x: str, flags: str) -> str:
    return f"transform(array({x}), x -> IF({_HAS_MARK}, regexp_replace(x, '{flags}{_MARKS}', ''), x))[0]"


#: Steps to tokens with a blank between any two. \x01 ends a line or sentence, two \x02 begin a line, two \x03 a sentence.
_STEPS = (
    r"replace(replace(replace({x}, '\u0001', ' '), '\u0002', ' '), '\u0003', ' ')",
    _unmarked("{x}", "(?m)"),
    r"regexp_replace({x}, '\\p{N}+', ' 0 ')",
    r"regexp_replace({x}, '([.!?](?:[ \\u00a0]?[\"”“»’)�])?) +(?=[\\p{Lu}¿¡«\"„“‘(])', '$1 \u0001 \u0003 \u0003 ')",
    r"regexp_replace({x}, '([^\\p{L}\\p{M}0\\s\\x01-\\x03])', ' $1 ')",
    r"regexp_replace(trim({x}), '[\\r\\n]\\s*', ' \u0001 \u0002 \u0002 ')",
    r"regexp_replace(concat('\u0002 \u0002 ', {x}, ' \u0001'), '[ \\t\\x0B\\f\\u00a0]{2,}|[\\t\\x0B\\f\\u00a0]', ' ')",
)
_CLASS = r"regexp_replace({x}, '(?<!\\S)\\p{Lu}\\S*', 'X')"


def _tokens(x: str) -> str:
    for step in _STEPS:
        x = step.replace("{x}", x)
    return x


def _class(x: str) -> str:
    return _CLASS.replace("{x}", x)


#: Three tokens in a row of one sentence or line, each with the mark of its end behind it; null where one is such a mark.
_TRIGRAMS = r"""transform(array(split(line, ' ')), a -> transform(slice(a, 1, greatest(size(a) - 3, 0)), (w, i) -> IF(w = '\u0001' OR a[i + 1] = '\u0001' OR a[i + 2] = '\u0001', NULL,
  concat(w, ' ', a[i + 1], ' ', a[i + 2], ' ', IF(a[i + 3] = '\u0001', '\u0001', '')))))[0]"""
#: The first 3 to 6 tokens of each line, from what stands between the lines' starts.
_ANCHORED = r"""flatten(transform(slice(split(line, '\\x02 \\x02 '), 2, 1000000000), l -> filter(transform(transform(array(3, 4, 5, 6), k -> substring_index(l, ' ', k)),
  p -> IF(p = l, NULL, concat('\u0002 ', p, ' ', IF(startswith(l, concat(p, ' \u0001')), '\u0001', '')))), g -> NOT rtrim('\u0001', g) RLIKE '[\\x01\\x03\\t-\\r]')))"""
#: (gram, n, ends): trigrams; and the first 3 to 6 tokens of lines, which begin with one \x02 and have 3 blanks or more.
GRAMS = rf"""
SELECT gram, sum(n) AS n, sum(IF(ended, n, 0)) AS ends FROM (
  SELECT rtrim(replace(g, '\u0001', '')) AS gram, right(g, 1) = '\u0001' AS ended, n FROM (
    SELECT g, count(*) AS n FROM (
      SELECT explode(concat({_TRIGRAMS}, {_ANCHORED})) AS g
      FROM (SELECT {_tokens("text")} AS line FROM (SELECT DISTINCT text FROM cairn_texts WHERE text IS NOT NULL)))
    WHERE g IS NOT NULL GROUP BY g))
GROUP BY gram
"""
#: GRAMS with one end for all distinct texts of one tail.
ONCE = """
SELECT gram, greatest(sum(n), 0) AS n, greatest(sum(ends), 0) AS ends FROM (
  SELECT gram, n, ends FROM cairn_all_grams
  UNION ALL SELECT explode(IF(whole = '', array(gram), array(gram, whole))), 1 - copies, 1 - copies FROM (
    SELECT gram, whole, count(DISTINCT body) AS copies FROM cairn_ends GROUP BY gram, whole, tail HAVING count(DISTINCT body) > 1))
GROUP BY gram
"""
#: The wider classes of the trigrams: trigram, pair and single token, told apart by the number of their blanks.
WIDER = rf"""
SELECT kind, sum(n) AS n, sum(ends) AS ends FROM (
  SELECT explode(array(kind, substring_index(kind, ' ', -2), substring_index(kind, ' ', -1))) AS kind, n, ends FROM (
    SELECT kind, sum(n) AS n, sum(ends) AS ends FROM (
      SELECT {_class("gram")} AS kind, n, ends FROM cairn_grams WHERE length(gram) - length(replace(gram, ' ', '')) = 2)
    GROUP BY kind))
GROUP BY kind
"""
#: How often words begin as a final word does, in its place, and go on: for trigrams and lines as they are, and for classes.
LONGER = r"""
SELECT raw, concat(head, left(word, k)) AS kind, sum(n) AS longer FROM (
  SELECT raw, head, word, n, explode(sequence(1, length(word) - 1)) AS k FROM (
    SELECT raw, left(kind, length(kind) - length(substring_index(kind, ' ', -1))) AS head, substring_index(kind, ' ', -1) AS word, n FROM (
      SELECT false AS raw, kind, n FROM cairn_wider WHERE kind RLIKE '(^| )\\p{Ll}\\p{L}+$'
      UNION ALL SELECT true, gram, n FROM cairn_grams WHERE gram RLIKE ' \\p{L}\\p{L}+$'))
  LEFT SEMI JOIN (SELECT DISTINCT raw AS r, left(kind, length(kind) - length(substring_index(kind, ' ', -1))) AS h FROM cairn_finals) ON raw = r AND head = h)
GROUP BY 1, 2
"""
_LAST_LINE = r"substring_index(replace(trim(TRAILING ' \t\r\n\u00a0' FROM text), '\r', '\n'), '\n', -1)"
_TAIL = rf"right({_unmarked(rf"right(trim(TRAILING ' \t\r\n\u00a0' FROM text), {TAIL + 40})", "")}, {TAIL})"
#: The last line of each text: its final trigram, and the whole line if it has 3 to 6 tokens and one sentence.
ENDINGS = rf"""
SELECT id, source, body, tail, gram, IF(substring_index(line, ' ', 1) = '\u0002' AND size(split(line, ' ')) BETWEEN 6 AND 9 AND instr(line, '\u0003') = 0, substring(line, 3, length(line) - 4), '') AS whole FROM (
  SELECT id, source, body, tail, line, substring_index(substring_index(line, ' ', -4), ' ', 3) AS gram FROM (
    SELECT id, source, xxhash64(text) AS body, xxhash64({_TAIL}) AS tail, {_tokens(_LAST_LINE)} AS line FROM cairn_texts WHERE text RLIKE '\\S'))
"""


def _smoothed(own: str, longer: str, prior: float, wider: str) -> str:
    """The share of ends without the one of the text and its copies, with ``wider`` for as many occurrences as ``prior`` says."""
    n, ends = f"greatest(coalesce(n{own}, 1) - 1, 0)", f"greatest(coalesce(ends{own}, 1) - 1, 0)"
    return f"({ends} + {prior} * {wider}) / ({n} + {longer} + {prior})"


def _judged(finals: DataFrame, grams: DataFrame, wider: DataFrame, longer: DataFrame, p0: float) -> DataFrame:
    """(gram, whole, p): from the last token alone to the whole line, each level smoothed by the one before."""
    finals = finals.withColumns({"k2": F.substring_index("kind", " ", -2), "k1": F.substring_index("kind", " ", -1)}).withColumnRenamed("kind", "k3")
    finals = finals.withColumn("p", F.lit(p0))
    as_is = grams.select(F.col("gram").alias("kind"), "n", "ends")
    for level, (key, table, raw) in enumerate((("k1", wider, False), ("k2", wider, False), ("k3", wider, False), ("gram", as_is, True), ("whole", as_is, True)), 1):
        names = (F.col("kind").alias(key), F.col("n").alias(f"n{level}"), F.col("ends").alias(f"ends{level}"))
        finals = finals.join(table.select(*names), key, "left")
        mine = longer.where(F.col("raw") == raw).select(F.col("kind").alias(key), F.col("longer").alias(f"l{level}"))
        finals = finals.join(mine, key, "left")
        p = F.expr(_smoothed(str(level), f"coalesce(l{level}, 0)", LINE_PRIOR if level == 5 else PRIOR, "p"))
        finals = finals.withColumn("p", p if level < 5 else F.when(F.col("whole") != "", p).otherwise(F.col("p")))
    return finals.select("gram", "whole", "p")


def find_truncated(df: DataFrame, doc_id: str, text: str, source: str | None = None) -> DataFrame:
    """(id, source, p_end, truncated), one row per row of ``df`` whose text is not null or blank.

    p_end is the smoothed share in which the text's final trigram ends a line or sentence elsewhere. Without
    ``source`` that column is null. Repeated rows are judged each by itself, null ids are kept. An empty
    table gives no rows; a text of one word has the line's start marks before it. Other columns are ignored.
    """
    texts = df.select(F.col(doc_id).alias("id"), (F.col(source) if source else F.lit(None).cast("string")).alias("source"), F.col(text).alias("text"))
    with _Views(df.sparkSession) as views:
        views.put("texts", texts)
        ends = views.put("ends", settle(views.sql(ENDINGS)))
        views.put("all_grams", views.sql(GRAMS))
        grams = views.put("grams", settle(views.sql(ONCE)))
        wider = views.put("wider", settle(views.sql(WIDER)))
        finals = ends.select("gram", "whole").distinct().withColumn("kind", F.expr(_class("gram")))
        kinds = F.array(*(F.struct(F.lit(False).alias("raw"), k.alias("kind")) for k in (F.col("kind"), F.substring_index("kind", " ", -2), F.substring_index("kind", " ", -1))),
                        *(F.struct(F.lit(True).alias("raw"), F.col(k).alias("kind")) for k in ("gram", "whole")))
        kinds = views.put("finals", settle(finals.select(F.explode(kinds).alias("k")).select("k.*").distinct()))
        longer = settle(views.sql(LONGER).join(kinds, ["raw", "kind"], "left_semi"))
    total = wider.where("instr(kind, ' ') = 0").agg(F.sum("ends").alias("e"), F.sum("n").alias("n")).first()
    asked = {raw: kinds.where(F.col("raw") == raw).select("kind") for raw in (True, False)}
    grams = grams.join(asked[True], F.col("gram") == F.col("kind"), "left_semi")
    judged = _judged(finals, grams, wider.join(asked[False], "kind", "left_semi"), longer, (total["e"] or 0) / max(total["n"] or 1, 1))
    # an ending of more than SPREAD texts has a copy of its one verdict for as many of them
    copies = ends.groupBy("gram", "whole").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("copies"))
    judged = judged.join(F.broadcast(copies.where("copies > 1")), ["gram", "whole"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))  # at most a row in SPREAD texts
    judged = settle(judged)
    large = F.broadcast(judged.where("copies > 1").select("gram", "whole", "copies"))
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    ends = ends.join(large, ["gram", "whole"], "left").withColumn("salt", F.pmod(F.xxhash64("id", "body"), F.coalesce("copies", F.lit(1))).cast("int"))
    return ends.join(judged, ["gram", "whole", "salt"]).select(
        F.col("id").alias(doc_id), F.col("source").alias(source or "source"), F.col("p").alias("p_end"), (F.col("p") < ENDS).alias("truncated")
    )


class _Views:
    """Temporary views under names of this run alone; the queries above name them cairn_*. They are gone at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.prefix, self.names = spark, f"cairn_{uuid.uuid4().hex}_", []

    def __enter__(self) -> _Views:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.catalog.dropTempView(name)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(self.prefix + name)
        self.names.append(self.prefix + name)
        return df

    def sql(self, query: str) -> DataFrame:
        return self.spark.sql(query.replace("cairn_", self.prefix))


def truncation_by_source(judged: DataFrame, source: str) -> DataFrame:
    """(source, n_texts, n_truncated, share) for every source; a null source is a source of its own."""
    return judged.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("truncated").alias("n_truncated"), F.avg(F.col("truncated").cast("int")).alias("share")
    )
