"""The whole pipeline against brute force, stage by stage, on a small corpus with planted cases."""

import importlib.util
import random
import sys
from pathlib import Path

import corpus_pipeline

from tablelens.llm import toxicity

_spec = importlib.util.spec_from_file_location("llm_brute", Path(__file__).with_name("test_operators.py"))
brute = importlib.util.module_from_spec(_spec)
sys.modules["llm_brute"] = brute
_spec.loader.exec_module(brute)


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    bad = [f"insult{i}" for i in range(6)]
    prose = lambda n: " ".join(f"w{rng.randrange(20000)}" for _ in range(n))
    passage, item = prose(60), prose(25)
    texts, toxic = [], []
    for i in range(240):
        lines = [prose(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 4))]
        toxic.append(int(i % 5 == 0))
        if toxic[-1]:
            lines[0] = f"{bad[i % 6]} {lines[0]} {bad[(i + 1) % 6]} {bad[(i + 2) % 6]}"
        if i % 9 == 1:
            lines.append(passage)
        if i % 17 == 3:
            lines[0] += f" {item}"
        if i % 13 == 7 and i > 20:
            lines = [brute.edited(texts[i - 1].split("\n")[0], 1), *texts[i - 1].split("\n")[1:]]
            toxic[-1] = toxic[-2]
        texts.append("\n".join(lines))
    texts += [None, ""]
    docs = brute.docs_of(spark, texts)
    labels = spark.createDataFrame([(i, t, 1) for i, t in enumerate(toxic)], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))

    model = toxicity.fit(docs, labels)
    gone = {r.doc_id for r in toxicity.score(docs, model).filter("toxic").collect()}
    assert len(gone ^ {i for i, t in enumerate(toxic) if t}) <= 4
    left = {i: t for i, t in enumerate(texts) if i not in gone}
    lost = brute.brute_lines(list(left.values()))
    left = {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in lost.get(k, [])) for k, (i, t) in enumerate(left.items())}
    ids = list(left)
    left = {i: left[i] for i, (_, c) in zip(ids, brute.brute_components(list(left.values()), 5), strict=True) if ids[c] == i}
    left = {i: t for i, t in left.items() if not brute.brute_contamination(t, [(1, item)])[1]}

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r["size"] for i, r in got.items()} == {i: len(brute.TOKEN.findall(t or "")) for i, t in left.items()}
    by: dict = {}
    for r in got.values():
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert own[0].source_size == sum(r["size"] for r in own) and sum(r.taken for r in own) == round(own[0].target)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "mix"]
