"""Association and relevance scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published ranking.
BM25_K, BM25_B, BM25_AVERAGE_LENGTH = 1.5, 0.65, 4497.0


def pmi(pair: Column, pairs: Column, first: Column, second: Column, characters: Column) -> Column:
    """log2 of how much likelier a pair is than its characters' chance; an unknown character counts as certain."""
    both = F.when((first > 0) & (second > 0), first * second / (characters * characters)).otherwise(F.lit(1.0))
    return F.log2((pair / pairs) / both)


def t_value(pair: Column, pairs: Column, first: Column, second: Column, characters: Column) -> Column:
    seen, chance = pair / pairs, (first / characters) * (second / characters)
    return (seen - chance) / F.sqrt(seen / pairs)


def chi_square(both: Column, first_only: Column, second_only: Column, neither: Column) -> Column:
    n = both + first_only + second_only + neither
    cross = both * neither - first_only * second_only
    return n * cross * cross / ((both + first_only) * (both + second_only) * (first_only + neither) * (second_only + neither))


def bm25(frequency: Column, idf: Column, doc_len: Column, k: float = BM25_K, b: float = BM25_B, average: float = BM25_AVERAGE_LENGTH) -> Column:
    """What one term adds to a document's score."""
    return (k + 1) * frequency * idf / (frequency + k * (1 - b + b * (doc_len / average)))


def sigmoid(x: Column, a: float = 0.0, b: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-(a + b * x)))


def linear(features: list[Column], weights: list[float]) -> Column:
    return sum((f * w for f, w in zip(features, weights, strict=True)), F.lit(0.0))
