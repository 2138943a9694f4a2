"""Records of a JSON document of any size, read by as many tasks as its file has splits.

The text reader cuts the document behind every closing brace. Whether a fragment begins inside a string is the parity of the quotes
before it, and how deep it begins is the sum of the brackets before it: both are prefix sums, first over the fragments of a split,
then over the splits of a file. Fragments that stay inside the containers of the path's array are glued to records by the number of
records ended before them. Only the others, which hold the document's skeleton (the keys around the array, other members), are
looked at token by token, to find where the array begins and ends.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparcel.session import ship, written

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[{}\[\]:,]', re.DOTALL)
#: Stands between pieces of different arrays; no JSON text may hold it.
SEAM = "\x01"


def target_of(keys: list[str]) -> list[str]:
    """The containers around the records: the root, an object for each key, the last an array."""
    kinds = ["{"] * len(keys) + ["["]
    return [kind + key for kind, key in zip(kinds, ["", *keys])]


def walk(text: str, inside: bool, depth: int, names: list[str | None], target: list[str]) -> tuple[list[str | None], list[str | None], str, bool]:
    """Reads a fragment from the state before it; ``names`` are the containers open there, one for each level up to the array's.

    Gives the containers opened last on each level, those open at the end, the pieces of the array, and whether it ends in it.
    """
    level, names, opened = len(target), list(names), [None] * len(target)
    at, key, last, pieces = 0, "", None, []

    def within() -> bool:
        return depth >= level and names == target

    begun = 0 if within() else None
    if inside:
        closing = re.match(r'(?:[^"\\]|\\.)*+"', text, re.DOTALL)
        at = closing.end() if closing else len(text)
    for token in TOKEN.finditer(text, at):
        mark = token[0][0]
        if mark == '"':
            last = token[0][1:-1] if token[1] else None
        elif mark == ":":
            key = last
        elif mark == ",":
            key = last = None
        elif mark in "{[":
            depth += 1
            if depth <= level:
                name = mark + ("" if depth == 1 else key) if depth == 1 or key is not None else None
                names[depth - 1] = opened[depth - 1] = name if name is not None else mark + "\x00"
                if within() and depth == level:
                    begun = token.end()
                    pieces.append(SEAM)
            key = last = None
        else:
            if depth == level and begun is not None and within():
                pieces.append(text[begun : token.start()])
                begun = None
            depth -= 1
            key = last = None
    if begun is not None:
        pieces.append(text[begun:])
    return opened, names, "".join(pieces), begun is not None


def _bare(text: Column) -> Column:
    """A text without its escape pairs, so that every quote left begins or ends a string."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\.", "")).otherwise(text)


def _brackets(bare: Column, inside: bool) -> Column:
    """Brackets outside strings, without the arrays that begin and end in the fragment."""
    out = F.regexp_replace(bare, '^[^"]*(?:"|$)', "") if inside else bare
    out = F.regexp_replace(F.regexp_replace(out, '"[^"]*(?:"|$)', ""), r"[^{\[\]]", "")
    for _ in range(3):
        out = F.replace(out, F.lit("[]"), F.lit(""))
    return out


def array_pieces(spark: SparkSession, paths: str | list[str], keys: list[str]) -> DataFrame:
    """``(_file, _text)``: the elements of the array below ``keys``, a few at a time, as texts of JSON arrays."""
    ship(spark)
    target = target_of(keys)
    level = len(target)
    fragments = spark.read.option("lineSep", "}").text(paths).select(
        F.col("value").alias("_text"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place")
    )
    bare = _bare(F.col("_text"))
    opens = lambda b: F.length(F.translate(b, "]", "")) - F.length(F.translate(b, "{[", ""))
    facts = fragments.select("_file", "_block", "_place", F.pmod(F.length(bare) - F.length(F.translate(bare, '"', "")), F.lit(2)).alias("_odd"), *[_brackets(bare, bool(k)).alias(f"_b{k}") for k in (0, 1)])
    facts = facts.select("_file", "_block", "_place", "_odd", *[x for k in (0, 1) for x in (opens(F.col(f"_b{k}")).alias(f"_d{k}"), F.length(F.translate(f"_b{k}", "{[", "")).alias(f"_l{k}"))])
    # outside a string at the end, the brace that ended the fragment closes a container
    for k in (0, 1):
        facts = facts.withColumn(f"_d{k}", F.col(f"_d{k}") - F.when(F.col("_odd") == k, 1).otherwise(0))
    facts = written(facts, "fragments")
    split = Window.partitionBy("_file", "_block").orderBy("_place")
    before, after = split.rowsBetween(Window.unboundedPreceding, -1), split.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    flipped = F.coalesce(F.bit_xor("_odd").over(before), F.lit(0))
    marked = facts.withColumn("_flipped", flipped)
    change = [F.when(F.col("_flipped") == k, F.col("_d0")).otherwise(F.col("_d1")) for k in (0, 1)]
    splits = marked.groupBy("_file", "_block").agg(F.bit_xor("_odd").alias("_odd"), *[F.sum(c).alias(f"_s{k}") for k, c in enumerate(change)])
    splits = splits.withColumn("_in", F.coalesce(F.bit_xor("_odd").over(earlier), F.lit(0)))
    splits = splits.withColumn("_deep", F.coalesce(F.sum(F.when(F.col("_in") == 0, F.col("_s0")).otherwise(F.col("_s1"))).over(earlier), F.lit(0)))
    splits = written(splits.select("_file", "_block", "_in", "_deep"), "splits")
    states = marked.join(splits, ["_file", "_block"]).withColumn("_inside", F.col("_flipped").bitwiseXOR(F.col("_in")))
    own, low = (F.when(F.col("_inside") == 0, F.col(f"_{c}0")).otherwise(F.col(f"_{c}1")) for c in "dl")
    states = states.select("_file", "_block", "_place", "_inside", "_odd", "_deep", own.alias("_own"), low.alias("_low"))
    states = states.withColumn("_to", F.col("_deep") + F.sum("_own").over(after)).withColumn("_from", F.col("_to") - F.col("_own"))
    skeleton = (F.col("_from") - F.col("_low") < level) | (F.col("_to") < level)
    ends = ((F.col("_to") == level) & (F.col("_inside").bitwiseXOR(F.col("_odd")) == 0)).cast("int")
    states = states.select("_file", "_block", "_place", "_inside", "_from", skeleton.alias("_skeleton"), ends.alias("_ends"), F.coalesce(F.sum(ends).over(before), F.lit(0)).alias("_n"))
    states = written(states, "states")
    counts = states.groupBy("_file", "_block").agg(F.sum("_ends").alias("_ends"))
    counts = counts.select("_file", "_block", F.coalesce(F.sum("_ends").over(earlier), F.lit(0)).alias("_base"))
    states = states.join(counts, ["_file", "_block"]).withColumn("_group", F.col("_n") + F.col("_base")).drop("_n", "_base", "_ends")
    rows = fragments.join(states, ["_file", "_block", "_place"])

    @F.pandas_udf("array<string>")
    def opened(text: pd.Series, inside: pd.Series, depth: pd.Series) -> pd.Series:
        return pd.Series([walk(t, bool(i), d, [None] * level, target)[0] for t, i, d in zip(text, inside, depth)])

    @F.pandas_udf("text string, within boolean")
    def pieces(text: pd.Series, inside: pd.Series, depth: pd.Series, names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([walk(t, bool(i), d, list(n), target)[2:] for t, i, d, n in zip(text, inside, depth, names)], columns=["text", "within"])

    # the skeleton's containers by level: the last one opened before a fragment is the one it is in, if it is that deep
    bones = written(rows.where("_skeleton").withColumn("_opened", opened("_text", "_inside", "_from")), "skeleton")
    along = Window.partitionBy("_file").orderBy("_block", "_place").rowsBetween(Window.unboundedPreceding, -1)
    names = F.array(*[F.when(F.col("_from") > k, F.last(F.get("_opened", F.lit(k)), ignorenulls=True).over(along)) for k in range(level)])
    bones = bones.withColumn("_names", names).withColumn("_piece", pieces("_text", "_inside", "_from", "_names"))
    bones = written(bones.select("_file", "_block", "_place", "_group", F.col("_piece.text").alias("_text"), F.col("_piece.within").alias("_within")), "bones")
    # a fragment of no skeleton is in the array if the last skeleton before it ends there
    ahead = bones.groupBy("_file", "_block").agg(F.max_by("_within", "_place").alias("_within"))
    ahead = splits.select("_file", "_block").join(ahead, ["_file", "_block"], "left")
    ahead = ahead.select("_file", "_block", F.last("_within", ignorenulls=True).over(earlier).alias("_begins"))
    flesh = states.where("NOT _skeleton").select("_file", "_block", "_place", "_group", F.lit(None).cast("boolean").alias("_within"), F.lit(True).alias("_flesh"))
    flesh = flesh.unionByName(bones.select("_file", "_block", "_place", "_group", "_within", F.lit(False).alias("_flesh")))
    flesh = flesh.withColumn("_last", F.last("_within", ignorenulls=True).over(before)).join(ahead, ["_file", "_block"])
    flesh = flesh.where(F.col("_flesh") & F.coalesce("_last", "_begins", F.lit(False))).select("_file", "_block", "_place", "_group")
    flesh = fragments.join(flesh, ["_file", "_block", "_place"]).withColumn("_text", F.concat("_text", F.lit("}")))
    bones = bones.withColumn("_text", F.when(F.col("_within"), F.concat("_text", F.lit("}"))).otherwise(F.col("_text"))).drop("_within")
    whole = flesh.unionByName(bones.select(*flesh.columns)).groupBy("_file", "_group").agg(F.array_sort(F.collect_list(F.struct("_block", "_place", "_text"))).alias("_parts"))
    parts = F.split(F.array_join(F.transform("_parts", lambda p: p["_text"]), ""), SEAM)
    parts = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[\s,]+|[\s,]+$", "")), lambda p: p != "")
    return whole.select("_file", F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("_text"))
