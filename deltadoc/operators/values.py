"""Pairing of typed values and the findings of what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltadoc import fixed
from deltadoc.functions import text as T

ENTITY = ("type", "source_text", "char_start", "char_end", "value_num", "value_str", "unit", "currency", "confidence", "kind", "context", "days_equivalent", "actor", "strength", "action", "frequency", "negated", "n")


def group_key(e: str = "") -> Column:
    """What a value may be compared with: the same type in the same role."""
    c = lambda n: F.col(f"{e}{n}")
    role = (
        F.when(c("type") == "MONEY", F.coalesce(c("currency"), F.lit("?"))).when(c("type") == "OBLIGATION", F.coalesce(c("actor"), F.lit("")))
        .when(c("type").isin("DURATION", "DATE"), F.coalesce(c("kind"), F.lit("general"))).when(c("type") == "PERCENT", F.coalesce(c("context"), F.lit("general")))
    )
    return F.concat_ws("|", c("type"), role)


def pair_values(a: DataFrame, b: DataFrame, scope: list[str]) -> DataFrame:
    """Values of two sides (``scope`` and the columns of ``ENTITY``) paired within scope and group, as ``pair_sides`` does."""
    own = lambda df, side: df.select(*scope, F.lit(side).alias("side"), *ENTITY)
    return pair_sides(own(a, "A").unionByName(own(b, "B")), scope)


def pair_sides(values: DataFrame, scope: list[str]) -> DataFrame:
    """Values (``scope``, side A or B, and the columns of ``ENTITY``) paired within scope and group.

    Equal values meet first, in order; the others meet by position, and what is left over stays alone. The
    result has ``scope``, group, seq (the pairs' order), and structs a and b. All values of a scope and group are
    dealt to one place once; windows do the rest there.
    """
    keys = [*scope, "group"]
    within = lambda *more: Window.partitionBy(*keys, *more)
    by = ["e.n", "e.char_start", "e.type"]
    value = F.struct(F.coalesce("e.value_num", F.lit(float("nan"))).alias("x"), F.coalesce("e.value_str", F.lit("")).alias("s"))
    rows = values.select(*scope, "side", group_key().alias("group"), F.struct(*ENTITY).alias("e")).repartition(*keys)
    rows = rows.withColumn("value", value).withColumn("turn", F.row_number().over(within("side", "value").orderBy(*by)))
    rows = rows.withColumn("at", F.row_number().over(within("side").orderBy(*by)))
    same = within("value", "turn")
    rows = rows.withColumn("equal", F.count("*").over(same) == 2).withColumn("first", F.max(F.when(F.col("side") == "A", F.col("at"))).over(same))
    place = F.row_number().over(within("side", "equal").orderBy("at"))
    rows = rows.withColumn("seq", F.struct(F.when(F.col("equal"), 0).otherwise(1).alias("late"), F.when(F.col("equal"), F.col("first")).otherwise(place).alias("at")))
    own = lambda side: F.first(F.when(F.col("side") == side, F.col("e")), ignorenulls=True).alias(side.lower())
    return rows.groupBy(*keys, "seq").agg(own("A"), own("B"))


def _value(e: str) -> Column:
    c = lambda n: F.col(f"{e}.{n}")
    t = c("type")
    duration = t.isin("DURATION", "PAYMENT_PERIOD", "NOTICE_PERIOD")
    made = F.struct(
        c("value_num").alias("value_num"), c("value_str").alias("value_str"), c("unit").alias("unit"), c("currency").alias("currency"), c("source_text").alias("source_text"),
        F.when(duration | (t == "DATE"), c("kind")).alias("kind"), c("context").alias("context"), c("actor").alias("actor"), c("action").alias("action"),
        c("strength").alias("strength"), c("frequency").alias("frequency"), c("days_equivalent").alias("days_equivalent"),
    )
    return F.when(F.col(e).isNotNull(), made)


def whole_date(iso: Column) -> Column:
    """A full ISO date as a date; days beyond a month's end run on into the next. Null where the year is unknown."""
    full = iso.rlike(r"^\d{4}-\d{2}-\d{2}$")
    month = F.when(full, F.try_to_date(F.concat(F.substring(iso, 1, 8), F.lit("01")), "yyyy-MM-dd"))
    return F.date_add(month, F.when(full, F.substring(iso, 9, 2).try_cast("int") - 1))


def strength_word(s: Column) -> Column:
    return F.when(s >= 5, "mandatory").when(s >= 3, "advisory").otherwise("permissive")


def findings(pairs: DataFrame) -> DataFrame:
    """What changed in each pair: category, summary, direction, old and new value, delta and confidence.

    Equal values in equal units give nothing, except obligations, which may differ in frequency or negation.
    """
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    is_new, is_gone = F.col("a").isNull(), F.col("b").isNull()
    one = is_new | is_gone
    ref = lambda n: F.when(is_gone, a(n)).otherwise(b(n))
    t = F.coalesce(a("type"), b("type"))
    rate, span = t.isin("PERCENT", "INTEREST_RATE"), t.isin("DURATION", "PAYMENT_PERIOD", "NOTICE_PERIOD")
    equal = F.coalesce(a("value_num").eqNullSafe(b("value_num")) & a("value_str").eqNullSafe(b("value_str")) & a("unit").eqNullSafe(b("unit")), F.lit(False)) & ~one
    difference = T.half_up(b("value_num") - a("value_num"), 2)
    share = F.when(a("value_num") != 0, T.half_up(difference / F.nullif(a("value_num"), F.lit(0.0)) * 100, 2))
    da, db = a("days_equivalent"), b("days_equivalent")
    timed = (da != 0) & (db != 0)
    gap = F.when(timed, T.half_up(db - da, 2))
    gap_share = F.when(timed, T.half_up(gap / F.nullif(da, F.lit(0.0)) * 100, 2))
    days = F.datediff(whole_date(b("value_str")), whole_date(a("value_str")))
    sa, sb = F.coalesce(a("strength"), F.lit(3)), F.coalesce(b("strength"), F.lit(3))
    differs = (sa != sb) | ~a("frequency").eqNullSafe(b("frequency")) | (F.coalesce(a("negated"), F.lit(False)) != F.coalesce(b("negated"), F.lit(False)))
    is_change = F.when(t == "OBLIGATION", one | differs).otherwise(~equal)

    sign = lambda x: F.when(x > 0, "+").otherwise("-")
    up = lambda x: F.when(x > 0, "increased").otherwise("decreased")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kind = F.replace(F.coalesce(ref("kind"), F.lit("general")), F.lit("_"), F.lit(" "))
    date_label = F.when(kind == "general", "Date").otherwise(text(F.upper(F.substring(kind, 1, 1)), F.substring(kind, F.lit(2), F.length(kind)), " date"))
    span_label = F.coalesce(T.lookup(ref("kind"), fixed.DURATION_LABEL), F.lit("Duration"))
    rate_label = F.coalesce(T.lookup(ref("context"), fixed.PERCENT_LABEL), F.lit("Percentage"))
    label = F.when(t == "DATE", date_label).when(span, span_label).when(rate, rate_label)
    plain = lambda e: F.when(t == "MONEY", T.amount(e("value_num"), e("currency"))).otherwise(e("source_text"))
    actor = T.title_case(F.coalesce(ref("actor"), F.lit("a party")))
    added_text = F.when(t == "MONEY", text("New amount introduced: ", plain(b), ".")).when(t == "OBLIGATION", text("Obligation added: ", actor, " ", b("value_str"), " ", b("action"), ".")).otherwise(text(label, " added: ", b("source_text"), "."))
    gone_text = F.when(t == "MONEY", text("Amount removed: ", plain(a), ".")).when(t == "OBLIGATION", text("Obligation removed: ", actor, " ", a("value_str"), " ", a("action"), ".")).otherwise(text(label, " removed: ", a("source_text"), "."))
    money_text = text("Amount ", up(difference), " from ", plain(a), " to ", plain(b), " — ", sign(difference), T.amount(F.abs(difference), b("currency")), F.when(share.isNotNull(), text(" (", sign(difference), T.number(F.abs(share)), "%)")).otherwise(""), ".")
    changed = lambda tail: text(label, " changed from ", a("source_text"), " to ", b("source_text"), tail, ".")
    date_tail = F.when(days != 0, text(" — moved ", T.plural(F.abs(days), "day"), " ", F.when(days > 0, "later").otherwise("earlier"))).otherwise("")
    longer = F.when(gap > 0, "longer").otherwise("shorter")
    span_tail = F.when(gap != 0, F.when(a("unit") == b("unit"), text(" — ", T.number(F.abs(difference)), " ", a("unit"), " ", longer)).otherwise(text(" — ", T.number(F.abs(gap)), " days ", longer))).otherwise("")
    rate_text = text(rate_label, " ", up(difference), " from ", T.number(a("value_num")), "% to ", T.number(b("value_num")), "% — ", sign(difference), T.number(F.abs(difference)), " percentage points.")
    duty = F.concat_ws(
        "; ",
        F.when(sa != sb, text('Requirement language changed from "', a("value_str"), '" (', strength_word(sa), ') to "', b("value_str"), '" (', strength_word(sb), ")")),
        F.when(~a("frequency").eqNullSafe(b("frequency")), text("frequency changed from ", F.coalesce(a("frequency"), F.lit("unstated")), " to ", F.coalesce(b("frequency"), F.lit("unstated")))),
        F.when(a("negated") != b("negated"), F.when(b("negated"), "the obligation was negated").otherwise("a negation was removed")),
    )
    duty_text = text(T.title_case(F.coalesce(b("actor"), F.lit("party"))), ": ", duty, ".")
    summary = (
        F.when(is_new, added_text).when(is_gone, gone_text).when(t == "MONEY", money_text).when(t == "DATE", changed(date_tail))
        .when(span, changed(span_tail)).when(rate, rate_text).otherwise(duty_text)
    )
    direction = (
        F.when(one & (t == "OBLIGATION"), F.when(is_new, "obligation_added").otherwise("obligation_removed")).when(is_new, "added").when(is_gone, "removed")
        .when(t == "MONEY", text("amount_", up(difference)))
        .when(t == "DATE", F.when(days > 0, "date_later").when(days < 0, "date_earlier").otherwise("date_changed"))
        .when(span, F.when(gap > 0, "duration_longer").when(gap < 0, "duration_shorter").otherwise("duration_changed"))
        .when(rate, text("percent_", up(difference)))
        .otherwise(F.when(sb < sa, "obligation_weakened").when(sb > sa, "obligation_strengthened").otherwise("obligation_changed"))
    )
    category = (
        F.when(t == "MONEY", "PRICING").when(t == "DATE", "DATES").when(span, T.lookup(ref("type"), fixed.DURATION_CATEGORY, "DURATION"))
        .when(rate, F.coalesce(T.lookup(ref("context"), fixed.PERCENT_CATEGORY), F.lit("PRICING"))).otherwise("OBLIGATIONS")
    )
    both = ~one
    delta = F.struct(
        F.when(both & (t == "MONEY"), difference).alias("absolute"),
        F.when(both & (t == "MONEY"), share).when(both & span, gap_share).alias("percentage"),
        F.when(both & rate, difference).alias("percentage_points"),
        F.when(both & (t == "DATE"), days.cast("double")).when(both & span, gap).alias("days"),
        F.when(both & (t == "OBLIGATION"), (sb - sa).cast("double")).alias("strength_change"),
        F.when(both & (t == "MONEY"), F.coalesce(a("currency"), b("currency"))).alias("unit"),
    )
    own = F.when(both & (t == "OBLIGATION"), 0.9).otherwise(1.0)
    sure = F.least(own, F.coalesce(a("confidence"), F.lit(1.0)), F.coalesce(b("confidence"), F.lit(1.0)))
    return pairs.where(is_change).withColumns({
        "category": category, "summary": summary, "direction": direction, "old_value": _value("a"), "new_value": _value("b"), "delta": delta, "sure": sure,
    })
