"""The model's feature table as a fitted transform.

``fit`` turns a table into small keyed statistics, written once; ``transform`` only
looks them up. Statistics come from the training rows alone (the default), or from
all rows when the caller passes them as ``statistics`` (transductive use).
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.functions import columns as fx, fixed
from cardwatch.operators import clean, encode, groups
from cardwatch.session import materialize
from cardwatch.sources.tables import (
    load_fitted_stats, load_published, publish_fitted_stats, save_fitted_stats,
)

LABEL = "isFraud"
ID = "TransactionID"


def prepare(df: DataFrame) -> DataFrame:
    """Row-wise part: cleaning, keys, time, amount and delta features."""
    out = clean.normalize_text(df)
    out = clean.sentinel_to_null(out)
    out = clean.encode_match_flags(out)
    if "DeviceType" in out.columns:
        out = out.fillna({"DeviceType": "missing"})
    new: dict[str, Column] = {
        "TransactionAmt_decimal": fx.amount_decimal(),
        "DT_M": fx.month_index(),
        "magic_uid": fx.behaviour_uid(out.columns),
        **{f"{c}_normalized": fx.normalized_delta(c) for c in ("D4", "D10", "D11", "D15")
           if c in out.columns},
    }
    if {"D1", "D15"} <= set(out.columns):
        new["outsider15"] = fx.outsider()
    for name, parts in _counts(out.columns).items():
        new[f"_key_{name}"] = F.concat_ws("_", *[
            F.coalesce(F.col(p).cast("string"), F.lit("nan" if i == 0 else "na"))
            for i, p in enumerate(parts)])
    return out.withColumns(new)


def _counts(columns: list[str]) -> dict[str, list[str]]:
    """Composite count keys whose parts are all there."""
    return {n: p for n, p in encode.COUNT_KEYS.items()
            if len(p) > 1 and "card4" not in p and set(p) <= set(columns)}


def _statistics(df: DataFrame) -> dict[str, tuple[str, dict[str, Column | str]]]:
    """table name -> (key, aggregates); of a table of distinct counts, the counted columns."""
    have = set(df.columns)
    card = {"card1_FE": F.count(F.lit(1))}
    for c in ("TransactionAmt", "D11", "D15"):
        if c in have:
            card[f"{c}_card1_mean"] = F.avg(c)
            card[f"{c}_card1_std"] = F.stddev_samp(c)
    uid, _ = groups.behaviour_stats(df.columns)
    tables = {
        "by_card1": ("card1", card),
        "by_uid": ("magic_uid", {**uid, "magic_uid_rows": F.count(F.lit(1))}),
        "by_uid_distinct": ("magic_uid", groups.behaviour_distinct(df.columns)),
    }
    if {"addr1", "D15"} <= have:
        tables["by_addr1"] = ("addr1", {
            "D15_addr1_mean": F.avg("D15"), "D15_addr1_std": F.stddev_samp("D15")})
    if "card2" in have:
        tables["by_card2"] = ("card2", {"card2_FE": F.count(F.lit(1))})
    for name in _counts(df.columns):
        tables[f"by_{name}"] = (f"_key_{name}", {name: F.count(F.lit(1))})
    return tables


def _read_by_fit(columns: list[str]) -> list[str]:
    """Columns some fitted table reads."""
    named = {
        ID, "TransactionDT", LABEL, "TransactionAmt", "magic_uid", "card1", "card2", "addr1",
        "C14", "D4", "D9", "D10", "D11", "D15", *fixed.SHARE_COLUMNS, *fixed.TARGET_COLUMNS,
        *fixed.MATCH_COLUMNS, *groups.BEHAVIOUR_DISTINCT.values(),
        *[f"C{i}" for i in range(1, 15)], *[p for ps in encode.COUNT_KEYS.values() for p in ps],
    }
    return [c for c in columns if c in named or c.startswith("_key_")]


def _fit_columns(df: DataFrame) -> DataFrame:
    return df.select(*_read_by_fit(df.columns))


class FeatureEstimator(Estimator):
    """Fits every lookup table the features need."""

    def __init__(self, statistics: DataFrame | None = None, folds: int = 5):
        super().__init__()
        self.statistics, self.folds = statistics, folds

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        # a dozen aggregations read these rows, so the columns they use are written once
        train = materialize(_fit_columns(prepare(dataset)), "prepared")
        source = train if self.statistics is None else materialize(
            _fit_columns(prepare(self.statistics)), "prepared")
        tables = {}
        for name, (key, aggs) in _statistics(source).items():
            if name == "by_uid_distinct":
                made = groups.distinct_counts(source, key, aggs)
            else:
                made = source.where(F.col(key).isNotNull()).groupBy(key).agg(
                    *[c.alias(n) for n, c in aggs.items()])
            tables[name] = materialize(made, name)
        shares = [c for c in fixed.SHARE_COLUMNS if c not in ("card4", "card1_addr1")]
        # text columns with a share go once it is taken, so they have no target mean
        gone = {c for c in shares if dict(train.dtypes).get(c) == "string"} | {"card4"}
        targets = [c for c in fixed.TARGET_COLUMNS if c in train.columns and c not in gone]
        fold = encode.contiguous_folds(train, k=self.folds)
        tables["shares"] = encode.fit_shares(train, shares)
        tables["target_sums"] = encode.fit_target_sums(train, targets, LABEL, fold)
        row = train.agg(F.avg(LABEL), F.count(F.lit(1))).first()
        rows = row[1] if self.statistics is None else source.count()
        return FeatureModel(tables, {
            "rate": row[0], "rows": rows, "shares": shares, "targets": targets,
            "inputs": _read_by_fit(dataset.columns), "tables": sorted(tables)}, fold)


class FeatureModel(Model):
    """Lookups only; ``transform_train`` encodes targets out of fold."""

    def __init__(self, tables: dict[str, DataFrame], metadata: dict, fold: Column | None = None):
        super().__init__()
        self.tables, self.metadata, self.fold = tables, metadata, fold

    def as_fitted(self, dataset: DataFrame) -> DataFrame:
        """The frame with the inputs of the fit: a missing one is an error, a later one is dropped."""
        inputs = set(self.metadata["inputs"])
        missing = sorted(inputs - {LABEL} - set(dataset.columns))
        if missing:
            raise ValueError(f"columns missing that the features were fitted on: {missing}")
        return dataset.drop(*[c for c in _read_by_fit(dataset.columns) if c not in inputs])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self._lookups(prepare(self.as_fitted(dataset)))
        means = encode.target_means(self.tables["target_sums"], self.metadata["rate"])
        return encode.apply_target(out, means, self.metadata["targets"], self.metadata["rate"])

    def transform_train(self, dataset: DataFrame) -> DataFrame:
        if self.fold is None:
            raise ValueError("folds are known only to the model that was just fitted")
        out = self._lookups(prepare(self.as_fitted(dataset).withColumn("_fold", self.fold)))
        return encode.apply_target_oof(
            out, self.tables["target_sums"], self.metadata["targets"], self.metadata["rate"],
            "_fold").drop("_fold")

    def _lookups(self, df: DataFrame) -> DataFrame:
        out = df
        _, fills = groups.behaviour_stats(df.columns)
        for name, (key, _) in _statistics(df).items():
            out = out.join(self.tables[name], key, "left")
        made = {
            "TransactionAmt_to_mean_card1": groups.ratio("TransactionAmt",
                                                         "TransactionAmt_card1_mean"),
            "TransactionAmt_to_std_card1": groups.ratio("TransactionAmt",
                                                        "TransactionAmt_card1_std"),
            "magic_uid_freq": F.coalesce(
                F.col("magic_uid_rows") / float(max(self.metadata["rows"], 1)), F.lit(0.0)),
        }
        for by in ("card1", "addr1"):
            if f"D15_{by}_mean" in out.columns:
                made[f"D15_to_mean_{by}"] = groups.ratio("D15", f"D15_{by}_mean")
                made[f"D15_to_std_{by}"] = groups.ratio("D15", f"D15_{by}_std")
        out = out.withColumns(made)
        out = out.drop("magic_uid_rows", "D15_card1_mean", "D15_card1_std", "D15_addr1_mean",
                       "D15_addr1_std", *[c for c in out.columns if c.startswith("_key_")])
        group_stats = [f"{c}_card1_{s}" for c in ("TransactionAmt", "D11")
                       for s in ("mean", "std")]
        out = out.fillna({
            **{c: v for c, v in fills.items() if c in out.columns},
            **{c: -1 for c in group_stats if c in out.columns}})
        return encode.apply_shares(out, self.tables["shares"], self.metadata["shares"])

    def save(self, path: str) -> None:
        save_fitted_stats(self.tables, self.metadata, path)

    def publish(self, root: str) -> str:
        """A new version below ``root``, current once it is whole."""
        return publish_fitted_stats(self.tables, self.metadata, root)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        tables, metadata = load_fitted_stats(spark, path)
        return cls(tables, metadata)

    @classmethod
    def current(cls, spark: SparkSession, root: str, version: str | None = None) -> FeatureModel:
        """The current, or a named, published version."""
        tables, metadata = load_published(spark, root, version)
        return cls(tables, metadata)


BASE_FEATURES = ["TransactionAmt", "TransactionAmt_decimal", "DT_M"]


def select_model_features(columns: list[str]) -> list[str]:
    """Ordered, de-duplicated feature names, by name pattern."""
    def holding(*parts: str) -> list[str]:
        return [c for c in columns if any(p in c for p in parts)]

    def ending(end: str) -> list[str]:
        return [c for c in columns if c.endswith(end)]

    chosen = (
        [c for c in BASE_FEATURES if c in columns]
        + holding("TransactionAmt_decimal", "TransactionAmt_to_mean", "TransactionAmt_to_std",
                  "D15_to_mean", "D15_to_std")
        + ending("_freq") + ending("_fraud_rate")
        + [c for c in columns if "magic_uid" in c or c == "outsider15"]
        + ending("_normalized") + ending("_FE")
        + holding("TransactionAmt_card1_", "D9_card1_", "D11_card1_"))
    return [c for c in dict.fromkeys(chosen) if c != "magic_uid"]
