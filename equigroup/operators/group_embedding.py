"""Group embedding (B1-B4) as a Spark ML estimator: ``fit`` chooses widths and
trains the groups' autoencoders, the model adds the latent columns by column
expressions. The fitted weights are one JSON parameter, so the model is saved,
loaded and put into a ``PipelineModel`` like any other stage. A null in a
group's features makes its latent columns null."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession

from equigroup.functions.columns import quote
from equigroup.operators.embed import ACTIVATIONS, latent_name
from equigroup.operators.embed_fit import fit_groups


class GroupEmbedding(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """``groups`` (JSON object: group number -> feature names), ``keyCol`` (draws
    the hold-out rows), ``lossThreshold``, ``maxDim`` and ``seed``."""

    groups = Param(Params._dummy(), "groups", "JSON: group number -> features", typeConverter=TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "row key", typeConverter=TypeConverters.toString)
    lossThreshold = Param(Params._dummy(), "lossThreshold", "hold-out MSE that is good enough", typeConverter=TypeConverters.toFloat)
    maxDim = Param(Params._dummy(), "maxDim", "greatest width", typeConverter=TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, groups="{}", keyCol="id", lossThreshold=1e-2, maxDim=5, seed=42):
        super().__init__()
        self._setDefault(groups="{}", keyCol="id", lossThreshold=1e-2, maxDim=5, seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> GroupEmbeddingModel:
        groups = {int(g): list(fs) for g, fs in json.loads(self.getOrDefault(self.groups)).items()}
        models, moments, tried = fit_groups(df, self.getOrDefault(self.keyCol), groups, self.getOrDefault(self.lossThreshold),
                                            self.getOrDefault(self.maxDim), self.getOrDefault(self.seed))
        own = [{"group": g, "features": groups[g], "width": d, "w1": w1.tolist(), "b1": b1.tolist(), "w2": w2.tolist(), "b2": b2.tolist()}
               for (g, d), (w1, b1, w2, b2) in sorted(models.items())]
        return GroupEmbeddingModel(weights=json.dumps({"groups": own, "moments": {f: [m, s] for f, m, s in moments}, "tried": tried}))


class GroupEmbeddingModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    weights = Param(Params._dummy(), "weights", "JSON of the fitted weights and moments", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, weights="{}"):
        super().__init__()
        self._setDefault(weights="{}")
        self._set(**self._input_kwargs)

    def _parts(self) -> tuple[list[dict], dict]:
        fitted = json.loads(self.getOrDefault(self.weights))
        return fitted["groups"], fitted["moments"]

    def latents(self) -> list[tuple[str, int, int]]:
        """(column name, group, dim) of the latent columns, in order."""
        return [(latent_name(g["group"], d, g["width"]), g["group"], d) for g in self._parts()[0] for d in range(g["width"])]

    def decoder(self, spark: SparkSession) -> DataFrame:
        """(group_id, dim, feature, w): the weights that push latent attributions to features."""
        rows = [(g["group"], d, f, g["w2"][d][i]) for g in self._parts()[0] for d in range(g["width"]) for i, f in enumerate(g["features"])]
        return spark.createDataFrame(rows, "group_id int, dim int, feature string, w double")

    def _transform(self, df: DataFrame) -> DataFrame:
        groups, moments = self._parts()
        out = []
        for g in groups:
            for d in range(g["width"]):
                terms = " + ".join(f"{g['w1'][i][d]!r}D * ((cast({quote(f)} as double) - {moments[f][0]!r}D) / {moments[f][1]!r}D)"
                                   for i, f in enumerate(g["features"]))
                z = f"({terms} + {g['b1'][d]!r}D)"  # greatest() would skip a null
                out.append(f"if({z} is null, null, {ACTIVATIONS['relu'].format(z=z)}) as `{latent_name(g['group'], d, g['width'])}`")
        return df.selectExpr("*", *out)
