"""SpotSigs document fingerprints (operator 4), DataFrame functions only.

A signature is a common word (anchor) with the next ``CHAIN`` content words after
it; common words in between are skipped.  Signatures gather where prose is and
leave out lists, menus and junk.  A document's set holds the digests of its
signatures; a text without any has its word sequence as its one signature, and a
text without words has the empty set.  Two sets are compared by Jaccard, where two
empty sets count as equal.

``near_pairs`` finds all pairs of a corpus above a threshold: equal sets are one
class; classes are partitioned by set length so that a class only meets lengths
within the threshold's ratio; inside a partition only the rarest signatures that
any partner must share are indexed; a pair is verified once.

Edge cases: null text is empty; repeated rows are fingerprinted once each (the next
document of a row is then its copy); a null doc_id comes first; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import shuffle_width, text_rows

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is was that for it with as on be at by this from or are an a "
    "der die das und ist von zu den mit sich des auf für nicht ein eine dem "
    "le la les de et est des en que une un du dans qui pour pas sur "
    "el los las y es por con para una su del se lo como no"
).split()
CHAIN = 3
#: Words after an anchor in which the chain must be complete.
REACH = 10
#: Documents per window of the next-document lookup.
BLOCK = 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of letters and digits, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _digest(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 12)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda variable of transform() over one element."""
    return F.get(F.transform(F.array(value), use), 0)


def _empty() -> Column:
    return F.array().cast("array<string>")


def _chains(words: Column) -> Column:
    """Signature digests of flagged words, in order, repeats included."""
    at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.substring(F.get(words, i - 1), 1, 1) == "+")
    after = lambda i: F.slice(F.filter(F.slice(words, i + 1, F.lit(REACH)), lambda w: F.substring(w, 1, 1) != "+"), 1, CHAIN)
    chains = F.filter(F.transform(at, lambda i: F.concat(F.array(F.get(words, i - 1)), after(i))), lambda c: F.size(c) == CHAIN + 1)
    return F.transform(chains, lambda c: _digest(F.array_join(c, " ")))


def _set_of(words: Column) -> Column:
    spots = F.array_sort(F.array_distinct(_chains(words)))
    whole = F.array(_digest(F.concat(F.lit("~"), F.translate(F.array_join(words, " "), "+", ""))))
    return F.when(F.size(words) == 0, _empty()).otherwise(_bound(spots, lambda s: F.when(F.size(s) > 0, s).otherwise(whole)))


def fingerprint(text: Column) -> Column:
    """Sorted distinct signature digests; the digest of the word sequence of a text that has words but no signature."""
    flagged = F.transform(words_of(text), lambda w: F.when(w.isin(ANCHORS), F.concat(F.lit("+"), w)).otherwise(w))
    return _bound(flagged, _set_of)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two fingerprints; 0 without a comparison where the set lengths alone rule out ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(large == 0, F.lit(1.0)).when(small < F.ceil(large * F.lit(least)), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def with_next(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, text and next_text (of the next doc_id in order; after the last: the first).

    Texts move once, to blocks of neighbouring doc_ids; the next text is a lead in the
    block.  A block's last row takes the first row of the next block that has rows,
    from a table of one row per block.
    """
    rows = text_rows(docs).withColumn("block", F.coalesce(F.floor(F.col("doc_id") / block), F.lit(-(2**62))))
    dealt = rows.repartition(shuffle_width(docs.sparkSession), "block")
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    inside = dealt.withColumn("next_in", F.lead("text").over(order))
    heads = rows.groupBy("block").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**62))).alias("doc_id"), F.col("text"))).alias("head"))
    ring = Window.orderBy("block")  # one row per block
    firsts = heads.select("block", F.coalesce(F.lead("block").over(ring), F.first("block").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next_block"))
    nexts = firsts.join(heads.select(F.col("block").alias("next_block"), F.col("head.text").alias("next_head")), "next_block").select("block", "next_head")
    last = inside.join(nexts, "block", "left")
    return last.select("doc_id", "text", F.coalesce("next_in", "next_head").alias("next_text"))


def edited(text: Column, after: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and the likeness to the edited and the next text."""
    rows = with_next(docs)
    rows = rows.select("doc_id", "text", edited(F.col("text"), F.col("next_text")).alias("edited"), "next_text")
    sets = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("f"),
        fingerprint(F.col("edited")).alias("e"),
        fingerprint(F.col("next_text")).alias("x"),
    )
    # likeness() reads each set several times
    bound = _bound(F.struct("f", "e", "x"), lambda s: F.struct(s["f"].alias("f"), s["e"].alias("e"), likeness(s["f"], s["e"]).alias("near_edited"), likeness(s["f"], s["x"]).alias("near_next")))
    out = sets.select("doc_id", "n_chars", "edited_sha256", bound.alias("b"))
    return out.select("doc_id", "n_chars", "edited_sha256", F.array_join("b.f", " ").alias("fingerprint"), F.array_join("b.e", " ").alias("edited_fingerprint"), "b.near_edited", "b.near_next")


def near_pairs(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """Pairs of classes (smallest doc_ids of equal fingerprints) with a Jaccard of ``least`` or more.

    Returns left_id, right_id, likeness; empty fingerprints link with nothing.
    """
    sets = text_rows(docs).select("doc_id", fingerprint(F.col("text")).alias("sigs")).where(F.size("sigs") > 0)
    classes = sets.groupBy("sigs").agg(F.min("doc_id").alias("class_id")).withColumn("n", F.size("sigs"))
    # lengths l and m can meet only if m >= least * l: with these partitions, in the same or the next one
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / least) + 1e-9)
    entries = classes.select("class_id", "n", part.alias("part"), F.explode("sigs").alias("sig"))
    rarity = entries.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = entries.join(rarity.where("df > 1"), "sig")
    # any partner shares at least ceil(least * n) signatures, so one of the rarest n - ceil(least * n) + 1;
    # signatures of one class alone come before the ranked ones and count as places
    order = Window.partitionBy("class_id").orderBy(F.desc("df"), F.desc("sig"))
    placed = ranked.withColumn("place", F.col("n") - F.row_number().over(order) + 1)
    prefix = placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1)
    home = prefix.select("class_id", "n", "sig", F.col("part"), F.lit(True).alias("home"))
    both = home.unionByName(prefix.select("class_id", "n", "sig", (F.col("part") + 1).alias("part"), F.lit(False).alias("home")))
    a, b = both.alias("a"), both.alias("b")
    met = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.part") == F.col("b.part")) & F.col("a.home") & (F.col("a.class_id") != F.col("b.class_id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least))
    pairs = met.select(F.least("a.class_id", "b.class_id").alias("left_id"), F.greatest("a.class_id", "b.class_id").alias("right_id")).distinct()
    full = pairs.join(classes.select(F.col("class_id").alias("left_id"), F.col("sigs").alias("ls")), "left_id").join(classes.select(F.col("class_id").alias("right_id"), F.col("sigs").alias("rs")), "right_id")
    return full.select("left_id", "right_id", likeness(F.col("ls"), F.col("rs"), least).alias("likeness")).where(F.col("likeness") >= least)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS nxt FROM d
), t AS (
  SELECT doc_id, text, nxt, substr(text, 1, length(text) - length(text) // 2) || substr(nxt, 1, length(text) // 2) AS edited FROM n
), v AS (
  SELECT doc_id, text, edited, unnest(['text', 'edited', 'nxt']) AS kind, unnest([text, edited, nxt]) AS body FROM t
), w AS (
  SELECT doc_id, text, edited, kind, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}]+') AS words FROM v
), c AS (
  SELECT *, list_filter(list_transform(range(1, len(words) + 1), lambda i: CASE WHEN list_contains([ANCHOR_LIST], words[i]) THEN
      {'a': words[i], 'f': list_filter(words[i + 1 : i + REACH], lambda x: NOT list_contains([ANCHOR_LIST], x))[1:CHAIN]} END), lambda s: s IS NOT NULL AND len(s.f) = CHAIN) AS chains FROM w
), s AS (
  SELECT doc_id, text, edited, kind, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(chains) = 0 THEN [substr(md5('~' || array_to_string(words, ' ')), 1, 12)]
      ELSE list_sort(list_distinct(list_transform(chains, lambda x: substr(md5('+' || x.a || ' ' || array_to_string(x.f, ' ')), 1, 12)))) END AS sigs FROM c
), p AS (
  SELECT doc_id, text, edited, max(sigs) FILTER (kind = 'text') AS f, max(sigs) FILTER (kind = 'edited') AS e, max(sigs) FILTER (kind = 'nxt') AS x FROM s GROUP BY ALL
)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(f, ' ') AS fingerprint, array_to_string(e, ' ') AS edited_fingerprint,
  CASE WHEN len(f) + len(e) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(f, e))::DOUBLE / (len(f) + len(e) - len(list_intersect(f, e))) END AS near_edited,
  CASE WHEN len(f) + len(x) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(f, x))::DOUBLE / (len(f) + len(x) - len(list_intersect(f, x))) END AS near_next
FROM p
""".replace("ANCHOR_LIST", ", ".join(f"'{a}'" for a in dict.fromkeys(ANCHORS))).replace("REACH", str(REACH)).replace("= CHAIN", f"= {CHAIN}").replace(":CHAIN", f":{CHAIN}")
