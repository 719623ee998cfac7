"""Consensus, exposure and foreknowledge over extracted statements.

A unit is (family, round, item) with at least two first-hand signers.  Everything below is joins,
aggregations and windows keyed by the unit; statements are normalized once.  Statements are aggregated before they
are joined, so that what is shuffled grows with the units, their values and signers, not with the statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.functions import text as T
from tracemark.plans.storage import stored

FIRST_HAND = ("observed_prompt", "answered")
AHEAD = ("predicted", "relayed")
UNIT = ["family", "round", "item"]
_ORDER = ["wall_time", "record_id"]
#: Items that are broadcast with their normal forms; more of them are joined over SPREAD copies, so that no item is one task's.
FEW_ITEMS, SPREAD = 16_381, 64
_READ = ("record_id", "wall_time", "signature", "family", "round", "item", "value", "kind", "used_cache")


def base(s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, statements with rounds, those of them that have one): all metrics below read them several times, so the
    normal forms and the units are worked out once and kept as tables."""
    s = stored(s.sparkSession, s.select(*[c for c in _READ if c in s.columns]), "statements")
    u = stored(s.sparkSession, units(s), "units")
    every = with_rounds(s, u)
    return u, every, every.filter("round IS NOT NULL")


def prepared(statements: DataFrame) -> DataFrame:
    """Statements with a usable time; item and value in normal form (an item's is worked out once, not in every row)."""
    s = statements.withColumn("wall_time", T.norm_time(F.col("wall_time"))).filter("wall_time <> ''")
    items = statements.select(F.col("item").alias("_item")).distinct().withColumn("_norm", T.norm_item(F.col("_item")))
    items = stored(statements.sparkSession, items, "items")
    same = F.col("item").eqNullSafe(F.col("_item"))
    if items.count() <= FEW_ITEMS:
        items = F.broadcast(items)
    else:
        s = s.withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.lit(SPREAD)))
        items = items.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        same = same & (F.col("_salt") == F.col("_copy"))
    s = s.join(items, same, "left").withColumn("item", F.col("_norm")).drop("_item", "_norm", "_salt", "_copy")
    return s.withColumn("value", F.nullif(T.digits(F.col("value")), F.lit("")))


def _signed(s: DataFrame) -> DataFrame:
    return s.filter(F.coalesce(F.col("signature"), F.lit("")) != "")


def units(s: DataFrame, least: int = 2) -> DataFrame:
    first = _signed(s).filter(F.col("kind").isin(*FIRST_HAND) & F.col("round").isNotNull())
    return first.groupBy(*UNIT).agg(F.countDistinct("signature").alias("n_first_hand")).filter(F.col("n_first_hand") >= least)


def with_rounds(s: DataFrame, u: DataFrame) -> DataFrame:
    """A missing round becomes that of the only unit of the same family and item; others stay null."""
    only = u.groupBy("family", "item").agg(F.min("round").alias("_r"), F.countDistinct("round").alias("_n")).filter("_n = 1").drop("_n")
    return s.join(only, ["family", "item"], "left").withColumn("round", F.coalesce("round", "_r")).drop("_r")


def consensus(s: DataFrame, u: DataFrame) -> DataFrame:
    """(unit, consensus_value): most distinct first-hand signers, then the earliest."""
    votes = _signed(s).filter(F.col("kind").isin(*FIRST_HAND) & F.col("value").isNotNull())
    n = votes.groupBy(*UNIT, "value").agg(F.countDistinct("signature").alias("n"), F.min(F.struct(*_ORDER)).alias("first"))
    best = n.groupBy(*UNIT).agg(F.min_by("value", F.struct(-F.col("n"), F.col("first"), F.col("value"))).alias("consensus_value"))
    return u.join(best, UNIT, "left")


def first_hand(s: DataFrame, u: DataFrame) -> DataFrame:
    """(unit, signature, wall_time, record_id, any_cache): the first first-hand row of each signer of a unit, and whether any of them used the cache."""
    rows = _signed(s).filter(F.col("kind").isin(*FIRST_HAND))
    first = rows.groupBy(*UNIT, "signature").agg(F.min(F.struct(*_ORDER)).alias("f"), F.max(F.coalesce("used_cache", F.lit(False))).alias("any_cache"))
    return first.join(u.select(*UNIT), UNIT, "left_semi").select(*UNIT, "signature", "f.*", "any_cache")


def reveals(s: DataFrame, c: DataFrame) -> DataFrame:
    """(unit, consensus_value, n_first_hand, reveal_time, revealer): the first row that carries the value."""
    rows = s.filter(F.col("kind").isin(*FIRST_HAND, "relayed") & F.col("value").isNotNull())
    first = rows.groupBy(*UNIT, F.col("value").alias("consensus_value")).agg(F.min(F.struct(*_ORDER, "signature")).alias("r"))
    first = first.select(*UNIT, "consensus_value", F.col("r.wall_time").alias("reveal_time"), F.col("r.signature").alias("revealer"))
    return c.join(first, [*UNIT, "consensus_value"], "left").select(*c.columns, "reveal_time", "revealer")


def told(s: DataFrame, u: DataFrame) -> DataFrame:
    """The units with their consensus and reveal, worked out once and kept as a table."""
    c = stored(s.sparkSession, consensus(s, u), "consensus")
    return stored(s.sparkSession, reveals(s, c), "reveals")


def lead_minutes():
    at = lambda c: F.unix_timestamp(F.to_timestamp(F.col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.round((at("wall_time") - at("reveal_time")) / 60, 4)


def receivers(s: DataFrame, r: DataFrame) -> DataFrame:
    """Signers of a unit but the revealer: exposed (strictly after the reveal), confirmed, lead."""
    f = first_hand(s, r).join(r.select(*UNIT, "reveal_time", "revealer"), UNIT)
    f = f.filter(~F.coalesce(F.col("signature") == F.col("revealer"), F.lit(False)))
    exposed = F.coalesce(F.col("wall_time") > F.col("reveal_time"), F.lit(False))
    return f.select(*UNIT, "signature", "wall_time", "reveal_time", exposed.alias("exposed"), (exposed & F.col("any_cache")).alias("confirmed"), F.when(exposed, lead_minutes()).alias("lead_minutes"))


def unit_table(s: DataFrame) -> DataFrame:
    """One row per unit with consensus, reveal and its receivers' counts."""
    u, _, rows = base(s)
    r = told(rows, u)
    n = receivers(rows, r).groupBy(*UNIT).agg(F.count(F.lit(1)).alias("receivers"), F.count_if("exposed").alias("exposed"), F.count_if("confirmed").alias("confirmed_use"))
    return r.join(n, UNIT, "left").fillna(0, ["receivers", "exposed", "confirmed_use"])


def totals(s: DataFrame) -> DataFrame:
    """The metrics document's headline figures, one row."""
    u, every, rows = base(s)
    r = told(rows, u)
    v = receivers(rows, r)
    a = v.agg(F.count(F.lit(1)).alias("receiver_rounds"), F.count_if("exposed").alias("exposed_upper"), F.count_if("confirmed").alias("confirmed_use"), F.round(F.median("lead_minutes"), 4).alias("lead_minutes_median"))
    share = lambda c: F.when(F.col("receiver_rounds") > 0, F.round(F.col(c) / F.col("receiver_rounds"), 4))
    top = r.filter("revealer IS NOT NULL").groupBy("revealer").agg(F.count(F.lit(1)).alias("n"))
    five = top.orderBy(F.desc("n"), "revealer").limit(5).agg(F.sum("n").alias("most"))
    top = top.agg(F.sum("n").alias("all")).crossJoin(five).select(F.round(F.col("most") / F.col("all"), 4).alias("top5_revealer_share"))
    dropped = every.agg(F.count_if(F.col("round").isNull()).alias("null_round_dropped"))
    n = u.agg(F.count(F.lit(1)).alias("n_units"))
    out = a.withColumn("exposed_share", share("exposed_upper")).withColumn("confirmed_share", share("confirmed_use"))
    return out.crossJoin(top).crossJoin(dropped).crossJoin(n)  # one row each


def wrong_values(s: DataFrame) -> DataFrame:
    """Other values of a unit, with their distinct signers; without a consensus every value is other."""
    u, _, rows = base(s)
    said = _signed(rows).filter(F.col("kind").isin(*FIRST_HAND, "relayed") & F.col("value").isNotNull())
    n = said.groupBy(*UNIT, "value").agg(F.countDistinct("signature").alias("n_signatures"))
    j = n.join(consensus(rows, u), UNIT).filter(~F.col("value").eqNullSafe(F.col("consensus_value")))
    return j.select(*UNIT, "value", "n_signatures")


def wrong_predictions(s: DataFrame) -> DataFrame:
    """Predicted items that aren't units although their family and round has one."""
    u, _, rows = base(s)
    p = rows.filter("kind = 'predicted'").groupBy(*UNIT).agg(F.sort_array(F.collect_set("value")).alias("values"), F.countDistinct(F.nullif("signature", F.lit(""))).alias("n_signatures"), F.min("wall_time").alias("first_time"))
    return p.join(u.select(*UNIT), UNIT, "left_anti").join(u.select("family", "round"), ["family", "round"], "left_semi")


def foreknowledge(s: DataFrame) -> DataFrame:
    """One row per receiver of a unit: item, value and after-other foreknowledge, posted before at all.

    The earlier rows of others are found from the two earliest signers of a unit, not by a self-join.
    """
    u, every, rows = base(s)
    c = stored(s.sparkSession, consensus(rows, u), "consensus")
    fh = stored(s.sparkSession, first_hand(rows, u), "firsts").select(*UNIT, "signature", F.col("wall_time").alias("fh_time"), F.col("record_id").alias("fh_record"))
    ahead = _signed(rows).filter(F.col("kind").isin(*AHEAD)).join(fh, [*UNIT, "signature"]).filter("wall_time < fh_time AND record_id <> fh_record").join(c.select(*UNIT, "consensus_value"), UNIT)
    a = ahead.groupBy(*UNIT, "signature").agg(F.min("wall_time").alias("ahead_time"), F.max(F.coalesce(F.col("value") == F.col("consensus_value"), F.lit(False))).alias("value_ahead"))
    starts = _signed(rows).groupBy(*UNIT, "signature").agg(F.min("wall_time").alias("t")).join(u.select(*UNIT), UNIT, "left_semi")
    two = starts.withColumn("k", F.row_number().over(Window.partitionBy(*UNIT).orderBy("t", "signature"))).filter("k <= 2")
    two = two.groupBy(*UNIT).agg(F.max(F.when(F.col("k") == 1, F.col("signature"))).alias("s1"), F.min("t").alias("t1"), F.max(F.when(F.col("k") == 2, F.col("t"))).alias("t2"), F.max(F.when(F.col("k") == 2, F.col("signature"))).alias("s2"))
    family = _signed(every).groupBy("family", "signature").agg(F.min("wall_time").alias("family_time"))
    j = fh.join(a, [*UNIT, "signature"], "left").join(two, UNIT, "left").join(family, ["family", "signature"], "left")
    other = F.when(F.col("s1") == F.col("signature"), F.col("t2")).otherwise(F.col("t1"))
    no = lambda x: F.coalesce(x, F.lit(False))
    after = no(other < F.col("ahead_time"))
    who = F.when(after, F.when(F.col("s1") == F.col("signature"), F.col("s2")).otherwise(F.col("s1")))
    return j.select(*UNIT, "signature", F.col("ahead_time").isNotNull().alias("item_ahead"), no(F.col("value_ahead")).alias("value_ahead"), after.alias("item_ahead_after_other"), no(F.col("family_time") < F.col("fh_time")).alias("posted_ahead"), who.alias("earlier_other"))


def flip(sided: DataFrame, flip_time: str, after: str) -> DataFrame:
    """(phase, side, n): answers before the flip, between, and after, of rows (wall_time, side)."""
    phase = F.when(F.col("wall_time") < flip_time, "before").when(F.col("wall_time") >= after, "after").otherwise("between")
    return sided.filter("kind = 'answered'").groupBy(phase.alias("phase")).pivot("side", ["padded", "dashboard"]).count().fillna(0)


def switchers(sided: DataFrame) -> DataFrame:
    """(signature, direction) of the signers who used both sides at different first times."""
    f = _signed(sided).groupBy("signature").agg(*[F.min(F.when(F.col("side") == x, F.col("wall_time"))).alias(x) for x in ("padded", "dashboard")])
    way = F.when(F.col("padded") < F.col("dashboard"), "to_dashboard").when(F.col("dashboard") < F.col("padded"), "to_padded")
    return f.select("signature", way.alias("direction")).filter("direction IS NOT NULL")


def share_of(rows: DataFrame, group: DataFrame, key: str = "signature") -> DataFrame:
    """(n, by_group, share) of the rows whose key is among those of ``group``."""
    marked = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(group.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    out = marked.agg(total(F.col("_n")).alias("n"), total(F.when(F.col("_in"), F.col("_n"))).alias("by_group"))
    return out.withColumn("share", F.when(F.col("n") > 0, F.round(F.col("by_group") / F.col("n"), 4)))


SCOUT_FLAGS = ("self_accelerates", "asks_others", "for_relay", "accepts_cost")  # fixed values


def checked_labels(labels: DataFrame, records: DataFrame) -> DataFrame:
    """Labels with at least one flag, and whether their quote stands in the record (scout_id) that they are about."""
    flagged = labels.filter(F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in SCOUT_FLAGS]))
    j = flagged.join(records.select("scout_id", "text", "wall_time", "page_family"), "scout_id", "left")
    stands = (F.coalesce(F.col("quote"), F.lit("")) != "") & T.squeeze(F.col("text")).contains(T.squeeze(F.col("quote")))
    return j.withColumn("stands", F.coalesce(stands, F.lit(False))).withColumn("wall_time", T.norm_time(F.col("wall_time"))).drop("text")


def scouts(checked: DataFrame) -> DataFrame:
    """(signature): signers of a standing label that says they ran ahead of their own clock."""
    return _signed(checked.filter("stands AND self_accelerates").select(F.col("signer").alias("signature"))).distinct()


def scout_shares(s: DataFrame, group: DataFrame) -> DataFrame:
    """(what, n, by_group, share): the group's part in statements of the units' families, first reveals, first mentions of a
    unit, and in what others said before a case of foreknowledge."""
    u, _, rows = base(s)
    r = told(rows, u)
    said = _signed(s).join(u.select("family").distinct(), "family", "left_semi")
    first = _signed(s).filter("round IS NOT NULL").join(u.select(*UNIT), UNIT, "left_semi").groupBy(*UNIT).agg(F.min(F.struct(*_ORDER, "signature")).alias("f"))
    sources = foreknowledge(s).filter("earlier_other IS NOT NULL").select(F.col("earlier_other").alias("signature"))
    sets = {"statements": said, "answer_reveals": _signed(r.select(F.col("revealer").alias("signature"))), "first_mentions": first.select("f.signature"), "foreknowledge_sources": sources}
    parts = [share_of(rows_.select("signature"), group).select(F.lit(what).alias("what"), "*") for what, rows_ in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
