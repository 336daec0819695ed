"""Benchmark decontamination by winnowing.

A text's fingerprint holds, for every window of 5 consecutive 4-word grams, the
leftmost gram of least hash.  Two texts that share 8 words in a row share such a
window, so they share a fingerprint at the same place of the span: joining the
fingerprints finds every shared span of 8 words.  The match is then extended
word by word, with the words around the item's fingerprint (at most 12) and the
text itself, and only true spans count.

Items of fewer than 8 words match as a whole; for each length that occurs among
them every gram of that length is a fingerprint (a window of one).  One pass
over a text makes its fingerprints for all lengths; a second extends the matches
and counts.

All of it is DataFrame operations.  The benchmark's fingerprints are counted
and go to all tasks when small; else both sides are shuffled by hash.

Nulls and texts without words have no windows; a null item id counts as the
empty string; items with equal ids count once; repeated documents are reported
each; document ids may be null or repeat; extra columns pass through, whatever
their names, and an added column that clashes gets a ``_`` in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, maybe_broadcast, stash, text_or_empty

SPAN, GRAM = 8, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# what stands between words, after and before A-Z is lower-cased
_GAPS, _GAPS_ANY_CASE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; nulls have none."""
    return F.array_remove(F.split(F.translate(text_or_empty(text), _UPPER, _LOWER), _GAPS, -1), "")


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text_or_empty(text), _GAPS_ANY_CASE, -1), ""))


#: low bits of a gram's number that hold its place, so the least number of a window is the leftmost of least hash
_PLACE = 30


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column worked out once a row: a generator keeps the planner from pulling it into filters and lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def fingerprints(texts: DataFrame, key: list[str], spans: list[tuple[int, int]]) -> DataFrame:
    """``key``, hash, at and span for the winnowed grams of texts with an array column ``words``.

    ``spans`` are (words of a span, words of a gram); ``at`` is the place of the
    gram's first word, from 1.
    """
    hashed = _once(texts, "_h", F.expr("transform(words, w -> xxhash64(w))")).drop("words")
    found = []
    for span, gram in spans:
        window = span - gram + 1
        g = ", ".join(f"_h[i + {j}]" for j in range(gram))
        grams = f"if(size(_h) >= {span}, transform(sequence(0, size(_h) - {gram}), i -> shiftleft(shiftright(xxhash64({g}), {_PLACE}), {_PLACE}) + i), array())"
        if window > 1:
            hashed = _once(hashed, f"_g{span}", F.expr(grams))
            least = ", ".join(f"_g{span}[i + {j}]" for j in range(window))
            grams = f"if(size(_g{span}) >= {window}, array_distinct(transform(sequence(0, size(_g{span}) - {window}), i -> least({least}))), array())"
        found.append(f"transform({grams}, m -> struct(shiftright(m, {_PLACE}) as hash, cast(m & {(1 << _PLACE) - 1} as int) + 1 as at, {span} as span))")
    return hashed.select(*key, F.explode(F.expr(f"concat({', '.join(found)})")).alias("_f")).select(*key, "_f.*")


def _spans_of(match: Column, span: int, gram: int) -> Column:
    """Starts of the spans that agree in text and item and hold the matching gram, as places in the text."""
    tests = []
    for j in range(span - gram + 1):  # the span begins j words before the gram
        mine = F.slice("words", F.greatest(match["at"] - j, F.lit(1)), span)
        theirs = F.slice(match["around"], F.greatest(match["left"] - j + 1, F.lit(1)), span)
        whole = (match["at"] > j) & (match["left"] >= j) & (F.size(mine) == span)
        tests.append(F.when(whole & (mine == theirs), match["at"] - j))
    return F.array_compact(F.array(*tests))


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_items: int = 2, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) with n_words, n_hit, n_items, items_sha256 and contaminated per document.

    Only matching fingerprints leave the first pass, and only their table takes
    part in a join.
    """
    keep = list(docs.columns) if keep is None else keep
    names = fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    bench = stash(items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), words(F.col(f"`{item_text_col}`")).alias("words")), "items")
    lengths = bench.filter(F.size("words").between(1, SPAN - 1)).select(F.size("words").alias("n")).distinct().orderBy("n").collect()
    spans = [(SPAN, GRAM), *[(r["n"], r["n"]) for r in lengths]]
    prints = None
    for span, gram in spans:  # an item's own length says what it is matched by
        own = bench.filter(F.size("words") >= SPAN if span == SPAN else F.size("words") == span).withColumn("all", F.col("words"))
        own = fingerprints(own, ["item", "all"], [(span, gram)])
        before = F.least(F.col("at") - 1, F.lit(span - gram))
        around = F.slice("all", F.col("at") - before, before + F.lit(span))
        own = own.select("item", "hash", "span", before.alias("left"), around.alias("around"))
        prints = own if prints is None else prints.unionByName(own)
    prints = stash(prints.distinct(), "prints")

    text = F.col(f"`{text_col}`")
    at = [F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text_or_empty(text)).alias("_hash")]
    texts = _once(docs.select(*at, text.alias("_text")), "words", words(F.col("_text"))).drop("_text")
    matched = fingerprints(texts, ["_id", "_hash"], spans).join(maybe_broadcast(prints, prints.count(), 400), ["hash", "span"])
    matches = matched.groupBy(F.col("_id").alias("_hit_id"), F.col("_hash").alias("_hit_hash")).agg(F.collect_set(F.struct("span", "at", "left", "around", "item")).alias("_matches"))
    matches = stash(matches, "matches")

    base = docs.select(*[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)], *at, text.alias("_text"))
    many = matches.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("_matches")).alias("all")).first()
    known = maybe_broadcast(matches, 40 * many["n"] + 200 * (many["all"] or 0), 1)
    out = base.join(known, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_hash") == F.col("_hit_hash")), "left")
    # texts without a match only need their words counted
    out = _once(out, "words", F.when(F.col("_matches").isNotNull(), words(F.col("_text"))))
    out = out.withColumn("_n_words", F.when(F.col("words").isNull(), word_count(F.col("_text"))).otherwise(F.size("words")).cast("long")).drop("_text")

    def extended(m: Column) -> Column:
        starts = F.lit(None).cast("array<int>")
        for span, gram in spans:
            starts = F.when(m["span"] == span, _spans_of(m, span, gram)).otherwise(starts)
        return F.struct(m["item"].alias("item"), m["span"].alias("span"), starts.alias("starts"))

    true = F.filter(F.transform("_matches", extended), lambda m: F.size(m["starts"]) > 0)
    out = _once(out, "_true", F.coalesce(true, F.array().cast("array<struct<item:string,span:int,starts:array<int>>>")))
    places = F.array_distinct(F.flatten(F.transform("_true", lambda m: F.transform(m["starts"], lambda s: F.struct(s.alias("start"), m["span"].alias("span"))))))
    covered = F.flatten(F.transform(places, lambda x: F.sequence(x["start"], x["start"] + x["span"] - 1)))
    hit_items = F.array_sort(F.array_distinct(F.transform("_true", lambda m: m["item"])))
    n_items = F.size(hit_items).cast("long")
    added = (F.col("_n_words"), F.size(F.array_distinct(covered)).cast("long"), n_items, F.sha2(F.array_join(hit_items, ",").cast("binary"), 256), n_items >= least_items)
    return out.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], *[c.alias(n) for c, n in zip(added, names)])


SQL = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item, len(win) AS n, array_to_string(win, ' ') AS win FROM (
    SELECT item, CASE WHEN len(w) < 8 THEN w ELSE w[i : i + 7] END AS win
    FROM item_words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 7, 1))) AS i) WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM wins),
doc_wins AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM doc_words, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i)
), hits AS (SELECT d.r, d.n, d.i, x.item FROM doc_wins d JOIN wins x ON d.n = x.n AND d.win = x.win),
covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, n, i FROM hits), LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS p) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc_words LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
