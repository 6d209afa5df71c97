"""Ranking, margins, deduplication, references and discourse."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_with_margin(scored: DataFrame, keys: list[str], ident: str, minimum: int, margin: int) -> DataFrame:
    """The best candidate of each key with its margin to the second, RESOLVED where both limits are met and the best is unique, else AMBIGUOUS (INSUFFICIENT below the minimum)."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), ident)
    ranked = scored.withColumn("_n", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    gap = F.col("score") - F.coalesce("second", F.lit(0))
    status = F.when(F.col("score") < minimum, "INSUFFICIENT").when(gap < margin, "AMBIGUOUS").otherwise("RESOLVED")
    return ranked.where("_n = 1").select(*keys, ident, "score", gap.alias("margin"), status.alias("status"))


def confidence(base: float, margin: Column) -> Column:
    return F.least(F.lit(0.99), F.lit(base) + margin / 100)


def suppress_contained(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items not contained in one that comes before them by (start, longer, priority, rule): the furthest end so far tells."""
    w = W.partitionBy(*keys).orderBy("start", F.desc("end"), F.desc("priority"), "rule_id").rowsBetween(W.unboundedPreceding, -1)
    return items.withColumn("_reach", F.max("end").over(w)).where("_reach is null or end > _reach").drop("_reach")


def shortest_at_start(items: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys, "start").orderBy(F.col("end") - F.col("start"), F.desc("priority"), "rule_id")
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def longest_at_end(items: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys, "end")
    return items.withColumn("_long", F.max(F.col("end") - F.col("start")).over(w)).where(F.col("end") - F.col("start") == F.col("_long")).drop("_long")


def longest_match(items: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy choice of non-overlapping items, longest first, then earliest: a recurrence, folded over the sorted items of a group."""
    sort = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("neg"), F.col("start"), F.col("end"))))
    grouped = items.groupBy(*keys).agg(sort.alias("_all"))
    none = F.filter("_all", lambda _: F.lit(False))
    kept = F.aggregate("_all", none, lambda a, x: F.when(F.exists(a, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), a).otherwise(F.concat(a, F.array(x))))
    return grouped.select(*keys, F.explode(kept).alias("_kept")).select(*keys, "_kept.start", "_kept.end")


def reference_pool(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", mention: str = "mention") -> DataFrame:
    """For every turn with a reference the earlier mentions, most recent first: recency (from 0) and score 100 - least(30, 4 * recency), current turn's mentions 110."""
    anchors = turns.where("is_reference").select(conv, F.col(turn).alias("at"))
    pool = turns.where(F.col(mention).isNotNull()).select(conv, F.col(turn).alias("seen"), mention)
    near = anchors.join(pool, conv).where("seen <= at")
    once = near.groupBy(conv, "at", mention).agg(F.max("seen").alias("seen"))
    w = W.partitionBy(conv, "at").orderBy(F.desc("seen"), mention)
    ranked = once.withColumn("recency", F.row_number().over(w) - 1)
    return ranked.withColumn("score", F.when(F.col("seen") == F.col("at"), 110).otherwise(100) - F.least(F.lit(30), 4 * F.col("recency")))


def former_latter(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", mention: str = "mention") -> DataFrame:
    """The last two mentions before each turn: latter and former (null where there are fewer)."""
    w = W.partitionBy(conv).orderBy(turn).rowsBetween(W.unboundedPreceding, -1)
    # each mention carries the one before it, so that no list grows along the conversation
    pair = F.when(F.col(mention).isNotNull(), F.struct(F.col(mention).alias("latter"), F.col("_before").alias("former")))
    seen = turns.withColumn("_before", F.last(mention, ignorenulls=True).over(w)).withColumn("_pair", pair).withColumn("_last", F.last("_pair", ignorenulls=True).over(w))
    return seen.withColumn("latter", F.col("_last.latter")).withColumn("former", F.col("_last.former")).drop("_before", "_pair", "_last")


def last_target(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", target: str = "target") -> DataFrame:
    """Turns without a target take the last explicit one before them: the common case of ellipsis."""
    w = W.partitionBy(conv).orderBy(turn).rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("resolved", F.coalesce(target, F.last(target, ignorenulls=True).over(w)))


def ellipsis_recurrence(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", target: str = "target", keep: int = 8, accept: int = 70, gap: int = 10) -> DataFrame:
    """Exact ellipsis: candidates are the last `keep` targets, scored 90 - least(30, 2 * distance); accepted from `accept` on and `gap` ahead of the next other
    target. An inferred target joins the history, so that this is a recurrence over the turns of a conversation."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema) + ", resolved string, status string"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(turn)
        history: list[tuple[int, str]] = []
        out, states = [], []
        for at, own in zip(group[turn], group[target], strict=True):
            if own is not None and own == own:
                out.append(own)
                states.append("EXPLICIT")
                history.append((at, own))
                continue
            best: dict[str, int] = {}
            for seen, name in history[-keep:]:
                best[name] = max(best.get(name, 0), 90 - min(30, 2 * (at - seen)))
            order = sorted(best.items(), key=lambda x: (-x[1], x[0]))
            if order and order[0][1] >= accept and (len(order) == 1 or order[0][1] - order[1][1] >= gap):
                out.append(order[0][0])
                states.append("INFERRED")
                history.append((at, order[0][0]))
            else:
                out.append(None)
                states.append("AMBIGUOUS" if order else "INSUFFICIENT")
        return group.assign(resolved=out, status=states)

    return turns.groupBy(conv).applyInPandas(run, schema)


#: Ordered markers of the relation between a text and the one before it: relation, pattern, confidence.
DISCOURSE = [
    ("causes", "^(so|therefore|thus|also|donc)[ ,]", 0.98),
    ("contrasts_with", "^(but|however|yet|mais|aber)[ ,]", 0.98),
    ("justifies", "^(because|since|car|weil)[ ,]", 0.98),
    ("precedes", "^(then|next|after|puis|dann)[ ,]", 0.92),
    ("alternative_to", "^(or|alternatively|ou|oder)[ ,]", 0.96),
    ("concedes", "^(although|though|still)[ ,]", 0.92),
    ("elaborates", "^(the|in|that|it)[ ,]", 0.6),
]


def discourse(items: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Relation of each text to the one before it, by the first marker that fits."""
    low = F.lower(F.col(text))
    relation = confidence_ = None
    for name, pattern, sure in DISCOURSE:
        hit = low.rlike(pattern)
        relation = F.when(hit, name) if relation is None else relation.when(hit, name)
        confidence_ = F.when(hit, sure) if confidence_ is None else confidence_.when(hit, sure)
    w = W.partitionBy(*keys).orderBy(order)
    return items.withColumn("previous", F.lag(order).over(w)).withColumn("relation", relation).withColumn("confidence", confidence_).where("previous is not null and relation is not null")


def modality(text: Column) -> dict[str, Column]:
    """Mood, speech act, force and polarity of a clause, each the first of its ordered patterns."""
    low = F.lower(text)
    question, order, negative = text.rlike("[?]$"), low.rlike("^(please|run|do|make|let|remove|add|keep) "), low.rlike("(^| )(not|never|no|ne|pas|nicht|kein) ")
    mood = F.when(question, "interrogative").when(order, "imperative").otherwise("declarative")
    act = F.when(question & low.rlike("^(can|could|would|will) you "), "request").when(question, "question").when(order, "command").otherwise("statement")
    force = F.when(low.rlike("(^| )(must not|may not|do not|not) "), "prohibition").when(low.rlike("(^| )(must|should|shall) "), "obligation").when(low.rlike("(^| )(may|can) "), "permission").otherwise("none")
    return {"mood": mood, "speech_act": act, "deontic": force, "polarity": F.when(negative, "negative").otherwise("positive")}

