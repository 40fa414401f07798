import os
import re
import subprocess
import sys

import corpus_pipeline as cp
from equigroup.llm import packing, pii
from equigroup.llm import quality as q
from equigroup.llm.common import read_table

from .test_dedup import best, digest
from .test_pii import base_spans
from .test_simhash import plain_groups
from .test_tokens import check_packing, hf  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_match_plain_versions(spark, sf_small, tmp_path, hf):  # noqa: F811
    docs = read_table(spark, sf_small, "documents")
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    before, kept = [tuple(r) for r in docs.collect()], None
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_small)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == COLUMNS
            kept = [tuple(r) for r in docs.collect()]
        if i == 0:
            model = q.fit_quality(read_table(spark, sf_small, "documents"), read_table(spark, sf_small, "labels"))
            want = [r for r in before if q.score_text(model, r[1] or "", q.Shapes()) >= 0.7]
            assert 0.6 * len(before) < len(want) < len(before)
        elif i == 1:
            groups = {}
            for r in before:
                groups.setdefault(digest(r[1]), []).append(r)
            want = [best(g) for g in groups.values()]
        elif i == 2:
            stay = {c for _, _, c in plain_groups([(r[0], r[1]) for r in before])}
            want = [r for r in before if r[0] in stay]
        elif i == 3:
            texts = {r[0]: r for r in before}
            for r in kept:
                old = texts[r[0]]
                assert not base_spans(r[1] or "") and r[4] == len(r[1] or "")
                if not base_spans(old[1] or "") and not re.search("[0-9]", old[1] or ""):
                    assert r == old
                rest = re.split("<(?:" + "|".join(k.name for k in pii.KINDS) + ")>", r[1] or "")
                assert re.match(".*".join(map(re.escape, rest)) + r"\Z", old[1] or "", re.S)
            want = kept
            assert {r[0] for r in kept} == set(texts)
        if i < 4:
            assert sorted(kept) == sorted(want)
            before = kept
    check_packing(docs.collect(), {r[0]: hf(r[1] or "") + [2] for r in kept})
    whole = cp.run(spark, sf_small)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole.collect()) == sorted(
        (r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect())


def test_stages_take_awkward_documents(spark, sf_small):
    from .helpers import AWKWARD, SCHEMA
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    for _, stage in cp.STAGES[1:4]:
        docs = stage(spark, docs, sf_small)
        assert docs.columns == COLUMNS
    assert cp.STAGES[4][1](spark, docs, sf_small).select("sequence_id").distinct().count() > 0
    for _, stage in cp.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), sf_small).count() == 0


def test_entry_lives_without_the_subpackage(tmp_path):
    """A copy of the repository without the llm folders still imports."""
    import shutil
    repo = os.path.dirname(os.path.abspath(cp.__file__))
    shutil.copytree(os.path.join(repo, "equigroup"), tmp_path / "equigroup", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(repo, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q, q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_queries_are_registered():
    import __spark_entry__ as e
    names = set(e.queries())
    assert {int(n[2:].split("_")[0]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14)) and "pipeline" in names
    assert {"op4_chat_format", "op8_exact_dedup", "op11_hard_negatives"} <= set(e.oracle_sql())
    assert packing.CAPACITY == 1024
