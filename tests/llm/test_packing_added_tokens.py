import zlib

import numpy as np
import pytest

from treeledger.llm import queries

pytest.importorskip("public_tokenizers")


def test_query_gives_added_tokens_the_ids_of_tokenizers(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y  <|endoftext|>", "<|endoftext", "no  such token \n "]
    texts += ["word <|endoftext|> été " * 400, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = set()
    for k, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        edges = sorted({0, *range(len(ids) % 1024 or 1024, len(ids), 1024)}) if len(ids) > 1024 else [0]
        for a, b in zip(edges, [*edges[1:], len(ids)], strict=True):
            expected.add((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    out = queries.op2_best_fit_packing(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in out} == expected and len(out) == len(expected)
