"""Sentiment by a small valence lexicon with negation, boosters and punctuation; thresholds and comparisons as columns.

The lexicon is a table that callers may replace: lexicon(word) -> valence on the usual -4..4 scale.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrow import arrow

# Own small lexicon: words and their valence.
LEXICON = {
    **dict.fromkeys("good nice fine glad like liked likes helpful useful fun easy clear safe fair".split(), 1.8),
    **dict.fromkeys("great happy love loved loves enjoy enjoyed beautiful brilliant win winner success best better thanks thank".split(), 2.7),
    **dict.fromkeys("amazing awesome excellent fantastic wonderful perfect outstanding superb".split(), 3.2),
    **dict.fromkeys("bad sad poor slow hard wrong boring weak sorry problem problems issue issues doubt".split(), -1.8),
    **dict.fromkeys("angry hate hated hates ugly fail failed failure fear pain loser stupid trash broken worse".split(), -2.5),
    **dict.fromkeys("terrible horrible awful worst disgusting pathetic worthless idiot moron scum disaster".split(), -3.2),
}
BOOST = {**dict.fromkeys("very really so extremely absolutely totally incredibly quite".split(), 0.293), **dict.fromkeys("slightly somewhat barely hardly almost kind sort".split(), -0.293)}
NEGATIONS = frozenset("not no never none nobody nothing neither nor cannot cant dont wont isnt arent wasnt doesnt didnt without".split())
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def valence(text: str, lexicon: dict[str, float] | None = None) -> tuple[float, float, float, float]:
    """(compound, positive, neutral, negative)."""
    lexicon = lexicon or LEXICON
    words = WORD.findall(text or "")
    low = [w.lower().replace("'", "") for w in words]
    shouting = 0 < sum(w.isupper() and len(w) > 1 for w in words) < len(words)
    scores = []
    for i, w in enumerate(low):
        v = lexicon.get(w, 0.0)
        if v:
            v += math.copysign(0.733, v) if shouting and words[i].isupper() else 0.0
            for back in (1, 2, 3):
                if i >= back and low[i - back] not in lexicon:
                    v += math.copysign(BOOST.get(low[i - back], 0.0), v) * (1 - 0.05 * (back - 1)) * (1 if BOOST.get(low[i - back], 0.0) >= 0 else -1) if low[i - back] in BOOST else 0.0
                    v *= -0.74 if low[i - back] in NEGATIONS else 1.0
        scores.append(v)
    if "but" in low:
        at = low.index("but")
        scores = [s * (0.5 if i < at else 1.5 if i > at else 1.0) for i, s in enumerate(scores)]
    total = sum(scores)
    mark = min(4, (text or "").count("!")) * 0.292 + (0.96 if (text or "").count("?") > 3 else 0.18 * (text or "").count("?") if (text or "").count("?") > 1 else 0.0)
    total += math.copysign(mark, total) if total else 0.0
    pos, neg, neu = sum(s + 1 for s in scores if s > 0), sum(s - 1 for s in scores if s < 0), sum(s == 0 for s in scores)
    if pos > abs(neg):
        pos += mark
    elif pos < abs(neg):
        neg -= mark
    whole = pos + abs(neg) + neu
    share = lambda x: round(abs(x) / whole, 3) if whole else 0.0
    return round(total / math.sqrt(total * total + 15), 4) if total else 0.0, share(pos), share(neu), share(neg)


@arrow("compound double, positive double, neutral double, negative double")
def polarity(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([valence(t) for t in texts.fillna("")], columns=["compound", "positive", "neutral", "negative"])


def label(compound: Column, positive: Column, negative: Column) -> Column:
    """MIXED where both sides are strong, else by the compound score at 0.05."""
    return F.when((positive > 0.3) & (negative > 0.3), "mixed").when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def analyze(posts: DataFrame, text: str = "text") -> DataFrame:
    """sentiment, sentiment_score, sentiment_confidence; empty texts are neutral with 0."""
    out = posts.withColumn("_p", polarity(F.col(text)))
    empty = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0
    compound = F.col("_p.compound")
    return out.withColumns(
        {
            "sentiment": F.when(empty, "neutral").otherwise(label(compound, F.col("_p.positive"), F.col("_p.negative"))),
            "sentiment_score": F.when(empty, 0.0).otherwise(compound),
            "sentiment_confidence": F.when(empty, 0.0).otherwise(F.abs(compound)),
        }
    ).drop("_p")


def distribution(scored: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("sentiment") == s).alias(s)
    return scored.agg(n("positive"), n("neutral"), n("negative"), F.coalesce(F.avg("sentiment_confidence"), F.lit(0.0)).alias("mean_confidence"))


def compare(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Agreement of two analysers on the same texts."""
    x, y = a.select(key, F.col("sentiment").alias("first")), b.select(key, F.col("sentiment").alias("second"))
    return x.join(y, key).withColumn("agree", F.col("first") == F.col("second"))


def dominant(intensities: Column) -> Column:
    """The label with the largest intensity of a map; ties by label; null for an empty map."""
    ordered = F.array_sort(F.transform(F.map_entries(intensities), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.get(ordered, F.lit(0))["k"]
