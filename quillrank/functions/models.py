"""Ranking models as column expressions.

A model gives the part of the score that one posting adds (`impact`) and, where it has one, the part that the document
adds by itself per query token (`document_part`).  What depends on the term alone is in `term_factors`, which is computed once
per term, before the postings are joined.  A user's model is a subclass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471806
LOG2E = 1.4426950
PI = 3.14159


@dataclass(frozen=True)
class Collection:
    ndocs: int
    nterms: int
    ntokens: int
    avg_doclen: float


class RankingModel:
    """Names of columns that expressions may use: tf, len, df, cf, and those of term_factors."""

    name = ""

    def term_factors(self, c: Collection) -> dict[str, Column]:
        return {}

    def impact(self, c: Collection) -> Column:
        raise NotImplementedError

    def document_part(self, c: Collection) -> Column | None:
        """Added once per query token, known or not; never positive beyond `document_bound`."""
        return None

    @staticmethod
    def length_ratio(c: Collection) -> Column:
        return F.col("len").cast("double") / F.lit(c.avg_doclen)


def _d(name: str) -> Column:
    return F.col(name).cast("double")


@dataclass(frozen=True)
class Bm25(RankingModel):
    k1: float = 0.9
    b: float = 0.2
    name = "bm25"

    def term_factors(self, c):
        n = F.lit(float(c.ndocs))
        return {"idf": F.greatest(F.lit(1e-6), F.log10((n - _d("df") + 0.5) / (_d("df") + 0.5)))}

    def impact(self, c):
        saturation = F.lit(self.k1) * (F.lit(1.0 - self.b) + F.lit(self.b) * self.length_ratio(c))
        return F.col("idf") * (_d("tf") * F.lit(self.k1 + 1.0)) / (_d("tf") + saturation)


@dataclass(frozen=True)
class F2Exp(RankingModel):
    """use_idf: whether the term's ((n + 1) / df)**k counts; by default it does not."""

    s: float = 0.7
    k: float = 0.35
    use_idf: bool = False
    name = "f2exp"

    def term_factors(self, c):
        return {"idf": F.pow(F.lit(c.ndocs + 1.0) / _d("df"), F.lit(self.k))} if self.use_idf else {}

    def impact(self, c):
        out = _d("tf") / (_d("tf") + F.lit(self.s) + F.lit(self.s) * self.length_ratio(c))
        return F.col("idf") * out if self.use_idf else out


@dataclass(frozen=True)
class DirichletLm(RankingModel):
    mu: float = 2500.0
    name = "lmdir"

    def term_factors(self, c):
        return {"prior": F.lit(self.mu) * _d("cf") / F.lit(float(c.ntokens))}

    def impact(self, c):
        return F.log(F.lit(1.0) + _d("tf") / F.col("prior"))

    def document_part(self, c):
        return F.log(F.lit(self.mu) / (_d("len") + F.lit(self.mu)))


@dataclass(frozen=True)
class Pl2(RankingModel):
    c: float = 12.0
    name = "pl2"

    def term_factors(self, c):
        return {"lambda": _d("cf") / F.lit(float(c.ndocs))}

    def impact(self, c):
        rate = F.col("lambda")
        tfn = _d("tf") * F.log(F.lit(1.0) + F.lit(self.c) / self.length_ratio(c)) / F.lit(LN2)
        bits = tfn * F.log(tfn / rate) / F.lit(LN2) + (rate - tfn) * F.lit(LOG2E) + F.lit(0.5) * F.log(F.lit(2.0 * PI) * tfn) / F.lit(LN2)
        return F.when(rate >= 1.0, F.lit(0.0)).otherwise(bits / (tfn + 1.0))


@dataclass(frozen=True)
class Spl(RankingModel):
    """At a rate of 1 the limit ln(1 + ndt)."""

    c: float = 9.0
    name = "spl"

    def term_factors(self, c):
        return {"lambda": _d("cf") / F.lit(float(c.ndocs))}

    def impact(self, c):
        rate = F.col("lambda")
        ndt = _d("tf") * F.log(F.lit(1.0) + F.lit(self.c) / self.length_ratio(c))
        inner = (F.pow(rate, ndt / (ndt + 1.0)) - rate) / F.when(rate == 1.0, F.lit(None)).otherwise(F.lit(1.0) - rate)
        return F.when(rate == 1.0, F.log(F.lit(1.0) + ndt)).otherwise(-F.log(inner))


@dataclass(frozen=True)
class NumTerms(RankingModel):
    cap: int = 500
    name = "numterms"

    def impact(self, c):
        value = F.col("tf").cast("long") + F.col("df").cast("long") - F.col("len").cast("long")
        return F.greatest(F.lit(0), F.least(value, F.lit(self.cap))).cast("double")


@dataclass(frozen=True)
class TfIdf(RankingModel):
    name = "tfidf"

    def term_factors(self, c):
        return {"idf": F.log10(F.lit(float(c.ndocs)) / _d("df"))}

    def impact(self, c):
        return F.col("idf") * F.log10(F.lit(1.0) + _d("tf"))


MODELS: dict[str, RankingModel] = {m.name: m for m in (Bm25(), F2Exp(), DirichletLm(), Pl2(), Spl(), NumTerms(), TfIdf())}
