"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, so sketches of any two texts
merge by union, and containment or likeness follows from the kept hashes alone, however unequal the texts. The
fraction is the whole range: likeness is the exact Jaccard likeness but for collisions of 48-bit hashes. The least hash
is kept beside them; it decides between texts without kept hashes.

Defined results: a null text counts as empty and has the fingerprint ``-:``; texts without words are alike (1.0);
repeated rows are documents of their own, ordered by hash of the text among equal ids; null ids come last; with a
single row the next document is that row itself; an empty table gives no row; extra columns are ignored. Ids are
numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .textvec import shingle_hashes

#: One in so many hashes is kept: every one, as short texts have too few shingles to leave any out.
SCALE = 1
_LIMIT = np.uint64((1 << 64) // SCALE - 1)
#: The upper 48 bits of the hash range are written.
_DROP = np.uint64(16 - (SCALE - 1).bit_length())
_NONE = "-"


def sketches(texts: list[str]) -> list[str]:
    """``<least hash>:<kept hashes>`` in hexadecimal, 12 digits each, ascending."""
    hashes, bounds = shingle_hashes(texts)
    low = hashes <= _LIMIT
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[low]
    kept = hashes[low] >> _DROP
    order = np.lexsort((kept, owner))
    owner, kept = owner[order], kept[order]
    fresh = np.ones(len(kept), dtype=bool)
    fresh[1:] = (kept[1:] != kept[:-1]) | (owner[1:] != owner[:-1])
    owner, kept = owner[fresh], kept[fresh]
    digits = kept.astype(">u8").tobytes().hex()
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        least = f"{int(hashes[bounds[i] : bounds[i + 1]].min()) >> 16:012x}" if bounds[i] < bounds[i + 1] else _NONE
        out.append(least + ":" + "".join([digits[16 * k + 4 : 16 * k + 16] for k in range(a, b)]))
    return out


def kept_hashes(sketch: str) -> set[str]:
    body = sketch.partition(":")[2]
    return {body[i : i + 12] for i in range(0, len(body), 12)}


def merge(a: str, b: str) -> str:
    """The sketch of two texts' shingles together."""
    least = min((x for x in (a.partition(":")[0], b.partition(":")[0]) if x != _NONE), default=_NONE)
    return least + ":" + "".join(sorted(kept_hashes(a) | kept_hashes(b)))


def containment(a: str, b: str) -> float:
    """Share of a's shingles that b has too."""
    left, right = kept_hashes(a), kept_hashes(b)
    if not left:
        return likeness(a, b)
    return len(left & right) / len(left)


def likeness(a: str, b: str) -> float:
    """Jaccard likeness. Where neither sketch kept a hash, equal least hashes decide."""
    if a == b:
        return 1.0
    left, right = kept_hashes(a), kept_hashes(b)
    if not left and not right:
        return float(a.partition(":")[0] == b.partition(":")[0])
    return len(left & right) / len(left | right)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(bounds: list[float], nulls: int) -> tuple[Column, int]:
    """The number of a row's range, ascending by (doc_id, _tie), null ids first, and how many ranges there are.

    A bound that comes n times is an id that many rows share: its rows are dealt to n ranges by their hashes, as rows
    without id are to ``nulls`` ranges. A bound is found in two steps of about the root of their number.
    """
    share = F.col("_tie") / F.lit(2.0**64) + F.lit(0.5)  # 0 to 1, ascending with the hash
    part = lambda n: F.least(F.floor(share * n), n - 1).cast("int")
    only_null = part(F.lit(nulls)) if nulls else F.lit(0)
    if not bounds:
        return F.when(F.col("doc_id").isNull(), only_null).otherwise(nulls).cast("int"), nulls + 1
    values = sorted(set(bounds))
    shared = [n if (n := bounds.count(b)) > 1 else 0 for b in values]
    step = math.isqrt(len(values)) + 1
    groups = [values[i : i + step] for i in range(0, len(values), step)]
    up_to = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    group = up_to(F.lit([g[0] for g in groups]))
    inner = F.element_at(F.array(*[F.lit(g) for g in groups]), group)
    passed = F.when(group > 0, (group - 1) * step + up_to(inner)).otherwise(0)
    # The interval after bound k begins where the one before ends, past the ranges of the bound's own id.
    starts, at = [nulls], nulls
    for n in shared:
        at += 1
        starts.append(at)
        at += n
    own = F.element_at(F.lit([0, *shared]), passed + 1)
    bound = F.element_at(F.lit([values[0] - 1, *values]), passed + 1)
    first = F.element_at(F.lit(starts), passed + 1)
    where = first + F.when((own > 0) & (F.col("doc_id") == bound), part(own)).otherwise(own)
    return F.when(F.col("doc_id").isNull(), only_null).otherwise(where).cast("int"), at + 1


def _ordered(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt to ranges of doc_id, each range with a helper row: the first row of the range that follows it.

    Range bounds come from approximate quantiles of the ids, and the rows at range ends from one small aggregate, so
    neither the driver nor a task sees more than a range and one row for each range. Within a range rows descend.
    """
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    without, total = docs.agg(F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    bounds = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 and total > without else []
    where, ranges = _range_of(bounds, -(-without * ranges // total) if without else 0)
    docs = docs.withColumn("_tie", F.xxhash64("text")).withColumn("_range", where)
    ends = docs.groupBy("_range").agg(F.max(F.struct(F.col("doc_id"), F.col("_tie"))).alias("top")).collect()
    ends = sorted(((r["_range"], r["top"]["doc_id"], r["top"]["_tie"]) for r in ends), key=lambda r: r[0])
    # The first row of the next lower range follows the last of this one; after the lowest range the highest begins.
    goes = [(low[0], low[1], low[2], ends[(i + 1) % len(ends)][0]) for i, low in enumerate(ends)]
    schema = f"_range int, _top_id {kind}, _top_tie long, _also int"
    helpers = spark.createDataFrame(goes, schema) if goes else spark.createDataFrame([], schema)
    rows = docs.join(F.broadcast(helpers), "_range", "left")  # a row for each range
    is_top = F.col("doc_id").eqNullSafe(F.col("_top_id")) & (F.col("_tie") == F.col("_top_tie"))
    main = F.struct(F.col("_range").alias("at"), F.lit(False).alias("helper"))
    extra = F.struct(F.col("_also").alias("at"), F.lit(True).alias("helper"))
    to = F.when(is_top & F.col("_also").isNotNull(), F.array(main, extra)).otherwise(F.array(main))
    rows = rows.select("doc_id", "text", "_tie", F.explode(to).alias("_to"))
    return rows.select("doc_id", "text", "_tie", F.col("_to.at").alias("_range"), F.col("_to.helper").alias("_helper")), ranges


def _compare(rows: list[tuple[object, str, str, str]]) -> Iterator[tuple]:
    """rows: (doc_id, text, next text, its own sketch is made here too)."""
    texts = [r[1] for r in rows]
    following = [r[2] for r in rows]
    changed = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    # Each text is the next one of the row before it, so only the last next text is new.
    prints = sketches([*texts, following[-1], *changed])
    own, later = prints[: len(rows)], prints[len(rows) + 1 :]
    for i, (doc_id, text, after, _) in enumerate(rows):
        other = own[i + 1] if i + 1 < len(rows) and after is texts[i + 1] else (prints[len(rows)] if i + 1 == len(rows) else sketches([after])[0])
        digest = hashlib.sha256(changed[i].encode("utf-8", "replace")).hexdigest()
        yield doc_id, len(text), digest, own[i], later[i], likeness(own[i], later[i]), likeness(own[i], other)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text; one shuffle, of each text once."""
    rows, ranges = _ordered(texts_of(docs))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # the row whose next row has not come yet
        wait: list[tuple] = []
        size = 0
        for frame in frames:
            out: list[tuple] = []
            for at, helper, doc_id, text in zip(frame["_range"], frame["_helper"], frame["doc_id"], frame["text"], strict=True):
                if held is not None and held[0] == at:
                    wait.append((held[1], held[2], text, ""))
                    size += len(held[2])
                    if size > 1 << 19:
                        out.extend(_compare(wait))
                        wait, size = [], 0
                held = None if helper else (at, doc_id, text)
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)
        if wait:
            yield pd.DataFrame(list(_compare(wait)), columns=COLUMNS)

    dealt = rows.repartitionById(ranges, "_range").sortWithinPartitions(F.col("_range"), F.col("_helper"), F.col("doc_id").desc_nulls_last(), F.col("_tie").desc())
    return dealt.select("_range", "_helper", "doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
