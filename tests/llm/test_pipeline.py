import random
import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("tables"))
    # Words of its own alphabet for each language.
    words = {"en": ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)], "xx": ["".join(rng.choices("rstuvwxyz", k=5)) for _ in range(400)]}
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    items = [(k, text("en", 30)) for k in range(3)]
    rows = [(k, "\n".join(text("en" if k % 2 else "xx", 20) for _ in range(4)), "en" if k % 2 else "xx", "s", 1) for k in range(60)]
    base = [w for r in rows[:4] for w in r[1].split()]
    near = list(base)
    near[7] = "changed"
    extra = {
        100: None,
        101: "123 -- 456",
        102: rows[5][1],  # an exact copy
        103: rows[8][1].split("\n")[0] + "\n" + text("xx", 40),  # one repeated line
        104: " ".join(base),
        105: " ".join(near),
        106: text("en", 10) + " " + items[1][1] + " " + text("en", 10),
        107: items[2][1][90:] + " x " + items[2][1][:90],
    }
    rows += [(k, t, None, None, None) for k, t in extra.items()] + [rows[11]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, extra


def test_stages(spark, folder):
    path, rows, extra = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(apply(spark, docs, path), name)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    given = {r[0] for r in rows}
    assert set(seen["language_id"]) == given - {100, 101}
    assert all(r.lang == ("en" if k % 2 else "xx") for k, r in seen["language_id"].items() if k < 60)
    assert set(seen["line_dedup"]) == given - {100, 101, 102}
    assert seen["line_dedup"][103].text == extra[103].split("\n")[1] and seen["line_dedup"][103].n_chars == len(extra[103].split("\n")[1])
    assert seen["line_dedup"][0].text == rows[0][1]
    assert set(seen["near_dedup"]) == given - {100, 101, 102, 105}
    assert set(seen["decontamination"]) == given - {100, 101, 102, 105, 106, 107}
    assert docs.where("doc_id = 11").count() == 1
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} == set(seen["decontamination"])
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= total / 1024 * 1.1 + 1


def test_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_are_the_dealt_ones():
    names = [re.sub("_", " ", name) for name, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "line dedup", "near dedup", "decontamination", "packing"]
