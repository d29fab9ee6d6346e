"""Pay in running text: the first range with a currency, else the figure that a word of pay or a period speaks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgework.functions import values as V
from sedgework.functions.dates import let

PAY = "struct<min:double,max:double,currency:string,period:string,raw:string>"


def places(text: Column, pattern: str) -> Column:
    """All matches of a pattern, as structs of start, end, raw, and the texts before and behind it up to the next match."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"), 1)
    return let(found, lambda raw: let(F.split(text, pattern), lambda between: _placed(raw, between)))


def _placed(raw: Column, between: Column) -> Column:
    step = lambda s, m: F.struct((s["at"] + F.length(F.get(between, F.size(s["out"]))) + F.length(m)).alias("at"), F.concat(s["out"], F.array(s["at"] + F.length(F.get(between, F.size(s["out"]))))).alias("out"))
    begins = F.aggregate(raw, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])
    return let(begins, lambda starts: F.transform(raw, lambda m, i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(m)).alias("end"), m.alias("raw"), F.get(between, i).alias("before"), F.get(between, i + 1).alias("behind"))))


def amount(figure: Column, thousands: Column) -> Column:
    return F.nullif(F.replace(figure, F.lit(","), F.lit("")), F.lit("")).cast("double") * F.when(thousands != "", 1000).otherwise(1)


def currency(sign: Column, code: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(code), F.lit("")), *[F.when(sign == s, F.lit(c)) for s, c in V.PAY_SIGNS.items()])


def period(a: Column, b: Column) -> Column:
    word = F.lower(F.coalesce(F.nullif(a, F.lit("")), b))
    return F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in V.PERIODS.items()], F.lit("year"))


def of_range(m: Column) -> Column:
    """The pay of a match of a range; null if "and" joins it and nothing says that a range comes, or a magnitude follows."""
    part = lambda k: F.regexp_extract(m["raw"], V.PAY_RANGE, k)
    return let(F.struct(amount(part(3), part(4)).alias("low"), amount(part(8), part(9)).alias("high")), lambda a: _of_range(m, part, a["low"], a["high"]))


def _of_range(m: Column, part: Callable[[int], Column], low: Column, high: Column) -> Column:
    trusted = (F.lower(part(5)) != "and") | (m["before"].rlike(V.PAY_INTRO) & (high > low))
    pay = F.struct(F.least(low, high).alias("min"), F.greatest(low, high).alias("max"), currency(part(1), part(2)).alias("currency"), period(part(10), part(11)).alias("period"), F.trim(m["raw"]).alias("raw"))
    return F.when(trusted & ~m["behind"].rlike(V.PAY_MAGNITUDE), pay)


def of_single(m: Column) -> Column:
    part = lambda k: F.regexp_extract(m["raw"], V.PAY_SINGLE, k)
    value = amount(part(3), part(4))
    return F.when(~m["behind"].rlike(V.PAY_MAGNITUDE), F.struct(value.alias("min"), value.alias("max"), currency(part(1), part(2)).alias("currency"), period(part(5), part(6)).alias("period"), F.trim(m["raw"]).alias("raw")))


def says_period(m: Column) -> Column:
    """Whether a single figure has a period other than a month."""
    said = F.concat(F.regexp_extract(m["raw"], V.PAY_SINGLE, 5), F.regexp_extract(m["raw"], V.PAY_SINGLE, 6))
    return (said != "") & (of_single(m)["period"] != "month")


def spoken_for(text: Column, figures: Column) -> Column:
    """The starts of the figures that a word of pay is nearest to, within its sentence and 60 characters; a word between two equally near speaks for none."""

    def gap(w: Column, f: Column) -> Column:
        ahead, behind = F.substring(text, f["end"] + 1, w["start"] - f["end"]), F.substring(text, w["end"] + 1, f["start"] - w["end"])
        cut = lambda x: F.coalesce(x.rlike(V.SENTENCE_MARKS), F.lit(False))
        return F.when(f["end"] <= w["start"], F.when(~cut(ahead), w["start"] - f["end"])).when(f["start"] >= w["end"], F.when(~cut(behind), f["start"] - w["end"])).otherwise(0)

    def nearest(w: Column) -> Column:
        gaps = F.transform(figures, lambda f: F.struct(gap(w, f).alias("gap"), f["start"].alias("start")))
        near = F.filter(gaps, lambda g: g["gap"].isNotNull())
        best = lambda n: let(F.array_min(F.transform(n, lambda g: g["gap"])), lambda least: F.when(least <= V.PAY_WINDOW, F.filter(n, lambda g: g["gap"] == least)))
        return let(let(near, best), lambda b: F.when(F.size(b) == 1, F.get(b, 0)["start"]))

    return F.transform(places(text, V.PAY_WORD), nearest)


def pay(text: Column) -> Column:
    """Struct of min, max, currency, period and raw; null if a text says no pay.

    The first range goes first, then the first single figure that a word of pay speaks for, then the first with a period (an hour or a year).
    """
    return let(text, _pay)


def _pay(text: Column) -> Column:
    ranges = F.filter(F.transform(places(text, V.PAY_RANGE), of_range), lambda p: p.isNotNull())
    pays = lambda figures, c: F.get(F.filter(F.transform(F.filter(figures, c), of_single), lambda p: p.isNotNull()), 0)
    spoken = lambda figures: let(spoken_for(text, figures), lambda near: pays(figures, lambda f: F.coalesce(F.array_contains(near, f["start"]), F.lit(False))))
    return F.coalesce(F.get(ranges, 0), let(places(text, V.PAY_SINGLE), lambda figures: F.coalesce(spoken(figures), pays(figures, says_period))))
