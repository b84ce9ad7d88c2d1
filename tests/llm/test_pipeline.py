import random
import re

import corpus_pipeline
from test_operators import WORDS, docs_df, odd_rows, prose, shingles, token_distance, norm


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(12)
    good = [(i, prose(rng, 60)) for i in range(120)]
    junk = [(500 + i, " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(8)) + " spam" * 40) for i in range(40)]
    item = prose(rng, 20)
    lines = [[prose(rng, 14) for _ in range(6)] for _ in range(10)]
    originals = [(300 + k, "\n".join(x)) for k, x in enumerate(lines)]
    near = [(720 + k, "\n".join([prose(rng, 14) if i == k % 6 else y for i, y in enumerate(x)])) for k, x in enumerate(lines)]  # one line in six is another
    rows = good + junk + originals + near + [(700, good[0][1]), (701, good[1][1] + "\n" + prose(rng, 50)), (702, prose(rng, 30) + " " + item + " " + prose(rng, 30))] + [(None if i is None else 800 + i, t) for i, t in odd_rows()]
    docs = docs_df(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, d).write.parquet(f"{d}/out{k}")
        now = spark.read.parquet(f"{d}/out{k}")
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen.append({r.doc_id: r for r in now.collect() if r.doc_id is not None})
    assert not any(i in seen[0] for i, _ in junk) and all(i in seen[0] for i, _ in good)
    copies = {i for i, _ in near}
    assert seen[1][0].text == good[0][1] and "\n" not in seen[1][701].text and seen[1][701].n_chars == len(seen[1][701].text)
    assert set(seen[0]) - set(seen[1]) == copies | {700, 806}  # emptied, or next to nothing left; nothing else is dropped
    assert all(seen[1][i].text == t for i, t in originals)
    sets = {i: shingles(r.text) for i, r in seen[2].items() if norm(r.text)}
    assert not any(a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.85 for a in sets for b in sets)
    assert set(seen[2]) - set(seen[3]) == {702} == {i for i, r in seen[2].items() if token_distance(norm(item), norm(r.text)) <= 4}
    packed = {}
    for r in now.collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.tokens
    assert packed == {i: len(re.findall(r"\S+", r.text)) for i, r in seen[3].items() if r.text and r.text.split()}
    whole = corpus_pipeline.run(spark, d)
    assert whole.columns == now.columns and sorted(map(tuple, whole.select("doc_id", "tokens").collect())) == sorted(map(tuple, now.select("doc_id", "tokens").collect()))
