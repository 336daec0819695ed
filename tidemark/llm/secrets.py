"""Secret scans through a trigram inverted index.

Every rule is a regular expression.  From its syntax tree follows a Boolean
query over trigrams of the lower-cased text that any match must satisfy: AND
along a sequence, OR over alternatives.

1. One pass over the texts finds which of the trigrams that some rule asks for
   stand in each.  They are turned into posting lists: for a trigram and a chunk
   of the documents (known by a 64-bit hash) the sorted list of those with it.
2. A rule's query is evaluated on the posting lists: AND intersects them, OR
   unites them.  What is left are the rule's candidates.
3. One more pass verifies: a rule with a query looks at its candidates only,
   rules without one, like runs of hex digits, look at every text.  Documents
   that share a hash only add candidates.

All of it is DataFrame operations.  Only hashes and lists of them are shuffled,
as long as the candidates are few enough to go to all tasks.

Spans count code points, end exclusive, leftmost non-overlapping per rule.
Nulls are empty texts; ids may be null or repeat; repeated rows are reported
each; extra columns pass through, whatever their names, and an added column that
clashes gets a ``_`` in front.
"""

from __future__ import annotations

import re
import re._constants as _c
import re._parser as _parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, fresh, hot_keys, maybe_broadcast, spread_join, stash, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``least``: code points that the match, or its group ``group``, must have to count."""

    kind: str
    pattern: str
    base: bool = False
    group: int = 0
    least: int = 1


# The three base kinds and the formats of common access keys.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?((?i:[A-Za-z0-9+/_.=-])+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", True, 0, 18),
    Rule("hex", r"[0-9a-f]+", True, 0, 16),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# -- from a regular expression to a trigram query ------------------------------------------------
#
# A query is True (no condition), ("and", parts), ("or", parts) or a trigram.

_MOST = 64  # exact strings followed at once


def _all(parts) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


#: letters from the commonest in running text to the rarest (fixed value); all other characters count as rarer
_COMMON = "etaoinshrdlcumwfgypbvkjxqz"
#: trigrams asked for of one string: the rarest say nearly all
_ASKED = 2


def _trigrams(string: str) -> list[str]:
    return list(dict.fromkeys(string[i : i + 3] for i in range(len(string) - 2)))


def _asked(string: str) -> list[str]:
    """The trigrams by which a string is looked up, in their order."""
    rare = sorted(_trigrams(string), key=lambda t: -sum(_COMMON.index(c) if c in _COMMON else 30 for c in t))[:_ASKED]
    return [t for t in _trigrams(string) if t in rare]


def _of_strings(strings: set[str]) -> object:
    """Every match holds one of these strings; alternatives that hold another are left out."""
    sets = {s: frozenset(_trigrams(s)) for s in sorted(strings)}
    return _any([_all(_asked(s)) for s, own in sets.items() if not any(other < own for other in sets.values())])


def _exact(op, arg) -> set[str] | None:
    """The lower-cased strings that a part can match, or None if they are too many to follow."""
    if op is _c.LITERAL:
        return {chr(arg).lower()}
    if op is _c.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is _c.LITERAL:
                out.add(chr(x).lower())
            elif kind is _c.RANGE and x[1] - x[0] < _MOST:
                out |= {chr(i).lower() for i in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 6 else None
    if op is _c.SUBPATTERN:
        return _exact_seq(arg[3])
    if op is _c.BRANCH:
        got = [_exact_seq(x) for x in arg[1]]
        return None if None in got else set().union(*got)
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[1] <= 3:
        one = _exact_seq(arg[2])
        return None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(sorted(one), repeat=n)}
    return None


def _exact_seq(seq) -> set[str] | None:
    out = {""}
    for op, arg in seq:
        one = _exact(op, arg)
        if one is None or len(out) * len(one) > _MOST:
            return None
        out = {a + b for a in out for b in one}
    return out


def _seq_query(seq) -> object:
    parts, run = [], {""}
    for op, arg in seq:
        one = _exact(op, arg)
        if one is not None and len(run) * len(one) <= _MOST:
            run = {a + b for a in run for b in one}
            continue
        parts.append(_of_strings(run))
        run = one if one is not None and len(one) <= _MOST else {""}
        if one is None:
            parts.append(_part_query(op, arg))
    return _all([*parts, _of_strings(run)])


def _part_query(op, arg) -> object:
    if op is _c.SUBPATTERN:
        return _seq_query(arg[3])
    if op is _c.BRANCH:
        return _any([_seq_query(x) for x in arg[1]])
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] > 0:
        return _seq_query(arg[2])
    return True


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every text with a match satisfies."""
    return _seq_query(_parser.parse(pattern))


def trigrams_of(query: object) -> list[str]:
    if query is True:
        return []
    if isinstance(query, str):
        return [query]
    return list(dict.fromkeys(t for p in query[1] for t in trigrams_of(p)))


# -- the index -----------------------------------------------------------------------------------

#: documents whose hashes share a posting list
CHUNK = 4096
_LIST = "array<bigint>"


def trigram_pattern(trigrams: list[str]) -> str:
    """An expression whose group 1 is, at each place where one of the trigrams begins, that trigram."""
    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(t[1:])
    return "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(map(re.escape, ends))})" for c, ends in by_first.items()) + "))"


def postings(docs: DataFrame, text: Column, doc: Column, trigrams: list[str], chunks: int) -> DataFrame:
    """The inverted index: chunk, trigram and docs, the sorted hashes of the chunk's documents that hold the trigram."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # all that rules ignore the case of
    found = F.array_distinct(F.regexp_extract_all(low, F.lit(trigram_pattern(trigrams)), F.lit(1)))
    held = docs.select(doc.alias("doc"), found.alias("trigrams")).filter(F.size("trigrams") > 0).withColumn("chunk", F.pmod("doc", F.lit(chunks)))
    # one shuffle, by chunk, serves the lists and their intersection
    each = held.repartition("chunk").select("chunk", "doc", F.explode("trigrams").alias("trigram"))
    return each.groupBy("chunk", "trigram").agg(F.array_sort(F.collect_set("doc")).alias("docs"))


def _matching(query: object, lists: Column) -> Column:
    """The documents of a chunk that satisfy a query, from the map of its posting lists."""
    if isinstance(query, str):
        return F.coalesce(F.element_at(lists, query), F.array().cast(_LIST))
    out = _matching(query[1][0], lists)
    for p in query[1][1:]:
        out = F.array_intersect(out, _matching(p, lists)) if query[0] == "and" else F.array_union(out, _matching(p, lists))
    return out


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """doc and the kinds whose query its postings satisfy."""
    lists = index.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists"))
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), _matching(q, F.col("lists")).alias("docs")) for kind, q in queries.items()])
    pairs = lists.select(F.explode(each).alias("m")).select("m.kind", F.explode("m.docs").alias("doc"))
    return pairs.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


# -- scanning ------------------------------------------------------------------------------------

_SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"
#: matches whose starts are summed up together
_BLOCK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def spans_of(rule: Rule, text: Column, number: int) -> Column:
    """Array of (``number``, start, end) of a rule's matches in a text, in order.

    The text splits at the matches, so a match starts after the lengths of all
    pieces and matches before it.  These are summed in blocks, so the work grows
    with the matches, not their square.  A run of one class that counts from
    some length on is matched from that length, which finds the same runs.
    """
    pattern = rule.pattern
    if rule.least > 1 and not rule.group and pattern.endswith("]+"):
        fixed = pattern.index("[")  # literal characters before the class
        pattern = pattern[:-1] + f"{{{rule.least - fixed},}}"
    long_enough = (lambda m: F.length(F.regexp_extract(m, pattern, rule.group)) >= rule.least) if rule.group else (lambda m: F.length(m) >= rule.least)
    empty = F.array().cast(_SPANS)

    def pieces(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        return F.zip_with(found, gaps, lambda m, g: F.struct(long_enough(m).alias("ok"), F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("n")))

    def located(p: Column) -> Column:
        part = lambda k: F.slice(p, k * _BLOCK + 1, F.lit(_BLOCK))
        blocks = F.sequence(F.lit(0), F.ceil(F.size(p) / _BLOCK).cast("int") - 1)
        sums = F.transform(blocks, lambda k: F.aggregate(part(k), F.lit(0).cast("long"), lambda total, x: total + x["gap"] + x["n"]))
        begins = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda out, n: F.array_append(out, F.element_at(out, -1) + n))

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            span = F.struct(F.lit(number).alias("kind"), begin.alias("start"), (begin + x["n"]).alias("end"))
            return F.struct((begin + x["n"]).alias("at"), F.when(x["ok"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return _let(begins, lambda at: F.flatten(F.transform(blocks, lambda k: F.aggregate(part(k), F.struct(F.element_at(at, k + 1).alias("at"), empty.alias("out")), step)["out"])))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda f: F.when(F.size(f) == 0, empty).otherwise(_let(pieces(f), located)))


def scan(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) with ``found``: all spans (kind number, start, end), by start, then kind.

    The index and the verification each read the texts once.
    """
    keep = list(docs.columns) if keep is None else keep
    found = fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), "found")[0]
    text = text_or_empty(F.col(f"`{text_col}`"))
    doc = F.xxhash64(F.col(f"`{id_col}`"), text)
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    queries = {kind: q for kind, q in queries.items() if q is not True}
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)], text.alias("_text"), doc.alias("_doc"))
    if queries:
        wanted = list(dict.fromkeys(t for q in queries.values() for t in trigrams_of(q)))
        index = stash(postings(docs, text, doc, wanted, -(-docs.count() // CHUNK) or 1), "postings")
        cand = stash(candidates(index, queries), "candidates").select(F.col("doc").alias("_doc"), F.col("kinds").alias("_kinds"))
        discard(index)
        small = maybe_broadcast(cand, cand.count(), 100)
        rows = rows.join(small, "_doc", "left") if small is not cand else spread_join(rows, cand, "_doc", hot_keys(rows.groupBy("_doc").agg(F.count(F.lit(1)).alias("n")), "_doc"), "left")
    empty = F.array().cast(_SPANS)
    told = lambda r: F.array_contains(F.coalesce("_kinds", F.array().cast("array<string>")), r.kind)
    each = [F.when(told(r), spans_of(r, F.col("_text"), i)).otherwise(empty) if r.kind in queries else spans_of(r, F.col("_text"), i) for i, r in enumerate(rules)]
    places = F.transform(F.flatten(F.array(*each)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = F.transform(F.array_sort(places), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(*[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], spans.alias(found))


def spans_text(found: Column, base_only: bool = False, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    if base_only:
        found = F.filter(found, lambda s: F.array_contains(F.array(*[F.lit(i) for i, r in enumerate(rules) if r.base]), s["kind"]))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        # marks each match of the rule, then counts along the pieces between the marks
        pattern = r.pattern.replace("'", "''")
        length = f"len(regexp_extract(m, '{pattern}', {r.group}))" if r.group else "len(m)"
        parts.append(
            f"""SELECT r, {i} AS k, '{r.kind}' AS kind, s, s + len(m) AS e FROM (
  SELECT r, m, sum(gap + len(m)) OVER (PARTITION BY r ORDER BY j) - len(m) AS s FROM (
    SELECT r, unnest(ms) AS m, unnest(list_transform(gs, lambda g: len(g))[1 : len(ms)]) AS gap, generate_subscripts(ms, 1) AS j
    FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM docs)))
WHERE {length} >= {r.least}"""
        )
    spans = "\nUNION ALL\n".join(parts)
    count = ",\n  ".join(f"CAST(count(*) FILTER (WHERE k = {i}) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(RULES) if r.base)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({spans})
SELECT doc_id, {count},
  sha256(coalesce({joined} FILTER (WHERE k < 3), '')) AS base_sha256,
  coalesce({joined}, '') AS spans
FROM docs LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""


SQL = _sql()
