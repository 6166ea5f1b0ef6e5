from treeledger.llm import line_dedup, queries

SCHEMA = "doc_id long, text string"
COMMON = "a common line of more than forty characters in all"
RARER = "a rarer line, also of more than forty characters"


def test_a_common_line_leaves_documents_that_share_a_rarer_one(spark, tmp_path):
    own = lambda k: f"own line {k} of a document, shared with no other"
    many = line_dedup.RARE + 20
    rows = [(k, f"{own(k)}\n{COMMON}") for k in range(many)]
    rows += [(1000, f"{own(1000)}\n{RARER}"), (1001, f"{RARER}\n{own(1001)}\n{COMMON}")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs, every_line=True).collect()}
    assert out[1001].text == own(1001) and out[1001].partners == [0, 1000]
    assert out[0].text == rows[0][1] and out[1000].text == rows[many][1]
    assert all(out[k].text == own(k) and out[k].partners == [0] for k in range(1, many))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    query = {r.doc_id: (r.n_deleted, r.partners) for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert query == {k: (r.n_deleted, r.partners) for k, r in out.items()}
