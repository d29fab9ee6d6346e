"""The nearest record of a table by the axes on which records agree, and values found again in the lines of their document.

Nearest: for every set of axes (of at least some weight) the records of equal values are one group, of which only the two smallest ids are kept;
a query looks up its own groups. So the best agreement is exact, and no two records of a hot value are ever paired.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedgework.functions.dates import let


def nearest_records(queries: DataFrame, records: DataFrame, axes: dict[str, int], least: int, key: str = "id") -> DataFrame:
    """(key, nearest, agreed, missed, weight) for each query that some other record agrees with on axes of weight ``least`` or more.

    ``axes`` are columns with their weights; null agrees with nothing. The nearest has the greatest weight of agreeing axes (ties: the set
    that is first by the axes' order, then the smallest key). ``queries`` may be rows of ``records``: a row is not its own neighbour.
    Axes are few: each set of them is a row of every record.
    """
    names = list(axes)
    sets = [s for n in range(1, len(names) + 1) for s in combinations(names, n) if sum(axes[a] for a in s) >= least]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        value = lambda a: F.col(a).cast("string")
        rows = [F.when(~F.exists(F.array(*[F.col(a).isNull() for a in s]), lambda x: x), F.struct(F.lit(i).alias("set"), F.to_json(F.array(*[value(a) for a in s])).alias("at"))) for i, s in enumerate(sets)]
        return df.select(F.col(key).alias(name), F.explode(F.array_compact(F.array(*rows))).alias("k")).select(name, "k.*")

    # the two smallest ids of a group by a rank that is limited below the shuffle; merged, as sizes foretold from a small file would broadcast all sets of its rows
    two = keyed(records, "r").withColumn("two", F.dense_rank().over(Window.partitionBy("set", "at").orderBy("r"))).where("two <= 2")
    held = two.groupBy("set", "at").agg(F.min(F.when(F.col("two") == 1, F.col("r"))).alias("one"), F.min(F.when(F.col("two") == 2, F.col("r"))).alias("two"))
    found = keyed(queries, "q").join(held.hint("merge"), ["set", "at"])
    found = found.withColumn("n", F.when(F.col("one") != F.col("q"), F.col("one")).otherwise(F.col("two"))).where("n IS NOT NULL")
    weight = F.element_at(F.array(*[F.lit(sum(axes[a] for a in s)) for s in sets]), F.col("set") + 1)
    best = found.groupBy("q").agg(F.max(F.struct(weight.alias("weight"), (-F.col("set")).alias("early"), (-F.col("n")).alias("less"))).alias("b"))
    agreed = F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in sets]), -F.col("b.early") + 1)
    all_ = F.array(*map(F.lit, names))
    return best.select(F.col("q").alias(key), (-F.col("b.less")).alias("nearest"), agreed.alias("agreed"), F.array_except(all_, agreed).alias("missed"), F.col("b.weight").alias("weight"))


def folded(text: Column) -> Column:
    """Lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def grams(text: Column, q: int) -> Column:
    """The different runs of q characters, the whole text if it is shorter: one walk over it, as a substring by number walks from the text's start each time."""
    return F.when(F.length(text) < q, F.array(text)).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))."), 1)))


def localized(values: DataFrame, lines: DataFrame, key: str, most: int = 2, q: int = 3) -> DataFrame:
    """Where each value stands in its document: (key, field, value, ord, at, said, distance), of the windows of as many words the one of least edit distance.

    ``values`` has the key, field, value; ``lines`` the key, ord, text. At most ``most`` edits (ties: the first line, then the first word). Lines are candidates if
    they share enough q-grams with the value: an edit breaks at most q of them. Values too short for that are compared with all lines of their document.
    Values that stand nowhere, and null ones, are left out; repeated values of a field are one.
    """
    v = values.select(key, "field", "value", folded(F.col("value")).alias("__v")).where("__v <> ''").distinct()
    v = v.withColumns({"__g": grams(F.col("__v"), q), "__n": F.size(F.split("__v", " "))})
    v = v.withColumn("__need", F.size("__g") - most * q)
    rows = lines.select(key, "ord", folded(F.coalesce("text", F.lit(""))).alias("__t")).where("__t <> ''")
    shared = v.where("__need > 0").select(key, "field", "value", "__need", F.explode("__g").alias("__q")).join(rows.select(key, "ord", F.explode(grams(F.col("__t"), q)).alias("__q")), [key, "__q"])
    lists = shared.groupBy(key, "field", "value", "ord").agg(F.count("*").alias("__c"), F.first("__need").alias("__need")).where("__c >= __need").select(key, "field", "value", "ord")
    short = v.where("__need <= 0").select(key, "field", "value").join(rows.select(key, "ord"), key)
    met = lists.unionByName(short).join(v.select(key, "field", "value", "__v", "__n"), [key, "field", "value"]).join(rows, [key, "ord"])
    each = lambda words: F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - F.col("__n"), F.lit(0))), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, F.col("__n")), " ").alias("said")))
    windows = let(F.split("__t", " "), each)  # parted once, not for every window
    each = met.select(key, "field", "value", "__v", "ord", F.explode(windows).alias("w")).withColumn("distance", F.levenshtein("__v", "w.said", most)).where("distance >= 0")
    best = each.groupBy(key, "field", "value").agg(F.min(F.struct("distance", "ord", F.col("w.at").alias("at"), F.col("w.said").alias("said"))).alias("b"))
    return best.select(key, "field", "value", F.col("b.ord").alias("ord"), F.col("b.at").alias("at"), F.col("b.said").alias("said"), F.col("b.distance").alias("distance"))
