"""The stages of the corpus pipeline against brute force on small documents, and the guard of the entry module."""

import os
import random
import re
import subprocess
import sys

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from casespark.llm.plans import tokenizer_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def documents():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    good = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 90))) for _ in range(80)]
    junk = [" ".join(rng.choice(words).upper() + "!!" for _ in range(40)) for _ in range(60)]
    near = [good[k] + f" tail{k}" for k in range(10)]
    texts = good + junk + [good[0].replace(" ", "  "), good[1]] + near + [good[5] + " mail ann.lee@corp.example.com now", None, ""]
    return list(enumerate(texts))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_stages_equal_brute_force(spark, tmp_path):
    rows = documents()
    d = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0 if t and "!!" in t else 1, 0) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before, after = dict(rows), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "quality":
            gone = set(before) - set(after)
            assert sum("!!" in (before[i] or "") for i in gone) >= 55 and sum("!!" not in (before[i] or "") for i in gone) <= 3
        elif name == "exact_dedup":
            groups = {}
            for i, t in before.items():
                groups.setdefault(re.sub(r"\s", "", t or ""), []).append((-len(t or ""), i))
            assert set(after) == {min(v)[1] for v in groups.values()}
        elif name == "near_dedup":
            sets = {i: shingles(t) for i, t in before.items()}
            ids, least = sorted(sets), {i: i for i in sets}
            for _ in range(3):
                for a in ids:
                    for b in ids:
                        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                            least[a] = least[b] = min(least[a], least[b])
            assert set(after) == {i for i in ids if least[i] == i}
        else:
            assert set(after) == set(before)
            assert all(t == before[i] for i, t in after.items() if "@" not in (before[i] or ""))
            assert not any("ann.lee" in (t or "") for t in after.values())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    reference = Tokenizer.from_file(tokenizer_path())
    reference.encode_special_tokens = True
    found = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        found[p.doc_id] = found.get(p.doc_id, []) + np.frombuffer(p.ids, "<u4").tolist()
    assert found == {i: reference.encode(t or "", add_special_tokens=False).ids + [0] for i, t in after.items()}
    run = corpus_pipeline.run(spark, d).collect()
    assert sorted((p.doc_id, p.start, p.ids) for p in run) == sorted((p.doc_id, p.start, p.ids) for p in pieces)


def test_stage_names_and_registration():
    import __spark_entry__ as entry
    assert len(corpus_pipeline.STAGES) == 5
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_entry_works_without_the_subpackage(tmp_path):
    """The entry module imports, and has the other queries, where the subpackage and the pipeline are missing."""
    for name in ("__spark_entry__.py", "oracles", "tools"):
        os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "casespark")
    for name in os.listdir(f"{ROOT}/casespark"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/casespark/{name}", tmp_path / "casespark" / name)
    code = ("import importlib.util as u, sys; sys.path.insert(0, %r); s = u.spec_from_file_location('__spark_entry__', %r); m = u.module_from_spec(s);"
            "import os; os.path.abspath = lambda p: %r; s.loader.exec_module(m); q = m.queries(); "
            "assert len(q) > 100 and 'pipeline' not in q and not any(x.startswith('op') for x in q); m.oracle_sql()")
    code %= (str(tmp_path), str(tmp_path / "__spark_entry__.py"), str(tmp_path / "__spark_entry__.py"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    assert done.returncode == 0, done.stderr[-800:]
