"""Headline tokens and lexicon polarity as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: default finance lexicon, and the marks stripped from words --
NEGATIVE_WORDS = [
    "crash", "plunge", "plummet", "collapse", "slump", "tumble", "dive", "sink",
    "selloff", "sell-off", "bear", "bearish", "downturn", "decline", "drop", "fall",
    "liquidation", "liquidated", "insolvency", "insolvent", "bankrupt", "bankruptcy",
    "hack", "hacked", "exploit", "breach", "stolen", "scam", "fraud", "ponzi",
    "ban", "banned", "crackdown", "lawsuit", "sue", "sued", "investigation", "probe",
    "halt", "halted", "freeze", "frozen", "suspend", "suspended", "default",
    "depeg", "de-peg", "contagion", "panic", "fear", "capitulation", "margin",
    "warning", "risk", "loss", "losses", "weak", "weakness", "concern", "worry",
]
POSITIVE_WORDS = [
    "surge", "soar", "rally", "rebound", "recover", "recovery", "gain", "gains",
    "bull", "bullish", "uptrend", "breakout", "record", "high", "growth", "rise",
    "adoption", "approval", "approved", "partnership", "launch", "upgrade",
    "institutional", "inflow", "accumulate", "accumulation", "optimism", "confidence",
    "milestone", "boost", "strong", "strength", "support", "expand", "expansion",
]
STRIPPED = ".,!?:;\"'()[]"

Scorer = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Whitespace-separated words, lower case, outer punctuation removed."""
    return F.transform(F.split(F.lower(F.trim(text)), r"[ \t\n\r]+"),
                       lambda w: F.btrim(w, F.lit(STRIPPED)))


def lexicon_scorer(negative: list[str] = NEGATIVE_WORDS,
                   positive: list[str] = POSITIVE_WORDS) -> Scorer:
    """Polarity (pos - neg) / (pos + neg) in [-1, 1]; 0 without a lexicon word."""
    lexicon = [*negative, *positive]

    def polarity(hits: Column) -> Column:
        pos, neg = F.size(F.filter(hits, lambda w: w.isin(positive))), F.size(F.filter(hits, lambda w: w.isin(negative)))
        return F.coalesce((pos - neg).cast("double") / F.nullif(pos + neg, F.lit(0)), F.lit(0.0))

    def score(text: Column) -> Column:
        hits = F.filter(words(F.coalesce(text, F.lit(""))), lambda w: w.isin(lexicon))
        # one-element transform: the matches are found once and used twice
        return F.transform(F.array(hits), polarity)[0]
    return score
