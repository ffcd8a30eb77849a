"""Regions of one screen: joining tiles, removing and marking duplicates."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def join_tiles(upper: list[str], lower: list[str], most: int) -> tuple[list[str], bool]:
    """Lines of two overlapping tiles as one, and whether the seam was found: the longest end of the upper that begins
    the lower, first as written (trailing blanks aside), then without any white space."""
    if not upper or not lower:
        return [*upper, *lower], True
    limit = min(len(upper), len(lower), max(1, most))
    written = ([x.rstrip() for x in upper], [x.rstrip() for x in lower])
    bare = (["".join(x.split()) for x in upper], ["".join(x.split()) for x in lower])
    for (end, start), loose in ((written, False), (bare, True)):
        for k in range(limit, 0, -1):
            if end[-k:] == start[:k] and (not loose or any(start[:k])):
                return upper + lower[k:], True
    return upper + lower, False


@F.pandas_udf(T.StructType([T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("verified", T.BooleanType())]))
def joined_tiles(upper: pd.Series, lower: pd.Series, most: pd.Series) -> pd.DataFrame:
    rows = [join_tiles(list(a), list(b), int(m)) for a, b, m in zip(upper, lower, most, strict=True)]
    return pd.DataFrame({"lines": [r[0] for r in rows], "verified": [r[1] for r in rows]})


def kept_regions(texts: list[str]) -> tuple[list[int], set[int]]:
    """Places (in reading order) of the regions that stay, and of those that stand for a removed one.

    White space aside, an equal text goes; of two where one holds the other and is at most twice as long, the
    shorter goes. The first kept region that decides, decides."""
    kept: list[int] = []
    stands: set[int] = set()
    bare = ["".join(t.split()) for t in texts]
    for k, key in enumerate(bare):
        rival = next((j for j in kept if bare[j] and key and (key == bare[j] or _holds(key, bare[j]))), None)
        if rival is None:
            kept.append(k)
        elif len(key) <= len(bare[rival]):
            stands.add(rival)
        else:
            kept.remove(rival)
            kept.append(k)
            stands = (stands - {rival}) | {k}
    return kept, stands


def _holds(a: str, b: str) -> bool:
    short, long_ = sorted((a, b), key=len)
    return short in long_ and 2 * len(short) >= len(long_)


def drop_duplicates(regions: DataFrame) -> DataFrame:
    """regions: content_id, reading_order, text. Those that stay, with `stands` (for a removed one). A screen has few
    regions, so one content is one group."""
    packed = regions.groupBy("content_id").agg(F.sort_array(F.collect_list(F.struct("reading_order", "text"))).alias("own"))

    @F.pandas_udf("array<struct<reading_order:int,text:string,stands:boolean>>")
    def stay(own: pd.Series) -> pd.Series:
        out = []
        for items in own:
            kept, stands = kept_regions([x["text"] or "" for x in items])
            out.append([{"reading_order": items[k]["reading_order"], "text": items[k]["text"], "stands": k in stands} for k in kept])
        return pd.Series(out)

    return packed.select("content_id", F.inline(stay("own")))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def likely_duplicates(texts: pd.Series) -> pd.Series:
    """Places of regions of 40 characters or more (white space aside) that are 85 % alike to another of the screen."""
    out = []
    for items in texts:
        bare = ["".join((t or "").split()) for t in items]
        marked: set[int] = set()
        for i in range(len(bare)):
            for j in range(i + 1, len(bare)):
                if min(len(bare[i]), len(bare[j])) >= 40 and difflib.SequenceMatcher(None, bare[i], bare[j]).ratio() >= 0.85:
                    marked |= {i, j}
        out.append(sorted(marked))
    return pd.Series(out)
