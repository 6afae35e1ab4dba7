from collections import Counter

import corpus_pipeline
import pytest
from test_jaccard_join import brute as brute_links
from test_mixing import brute as brute_mix
from test_mixing import size_of
from test_token_files import want as brute_tokens

from keystrata.llm.decontaminate import Index, find
from keystrata.llm.text import read_table
from keystrata.llm.toxicity import Scorer, train

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before the first stage and after each."""
    docs = read_table(spark, SF, "documents")
    extra = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "x", None, "src1", 1), (9002, "x", None, "src1", 1), (None, "words of a document without an id here", "en", "src2", 3)], docs.schema)
    out = [docs.unionByName(extra)]
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    assert all(df.columns == COLUMNS for df in stages[:5]) and corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go(spark, stages):
    scorer = Scorer(train(stages[0], read_table(spark, SF, "labels")))
    before = rows(stages[0])
    keep = [scorer.score(m) < 0.7 for m in scorer.marginals([r[1] or "" for r in before])]
    assert Counter(rows(stages[1])) == Counter(r for r, k in zip(before, keep, strict=True) if k)


def test_one_document_of_each_group_stays(stages):
    classes = {c for _, c, _ in brute_links(rows(stages[1]))}
    assert sorted(str(r[0]) for r in rows(stages[2])) == sorted(map(str, classes))


def test_contaminated_documents_go(spark, stages):
    index = Index([(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()])
    before = rows(stages[2])
    bad = {d for d, *_ in find(index, [r[1] or "" for r in before])}
    assert bad and Counter(rows(stages[3])) == Counter(r for k, r in enumerate(before) if k not in bad)


def test_documents_are_mixed(stages):
    want = Counter()
    for doc_id, size, _, taken in brute_mix(rows(stages[3]), 1 << 18)[0]:
        want[doc_id, size] += int(taken / size + 0.5) if size else 0
    assert Counter((r[0], size_of(r[1])) for r in rows(stages[4])) == +want


def test_tokens_are_read_back(stages):
    assert sorted((tuple(r) for r in stages[5].collect()), key=lambda r: r[1]) == brute_tokens(rows(stages[4]))


CLASHING = "__key __id key id_ mix_id MIX_WORDS hub band cid label set_key y chosen_id text_ bytes shard start".split()


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_clashing_names_long_texts_and_empty_tables(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, "a short text of a few words", "s"), (1, "a short text of a few words", "s"), (2, None, None), (3, long, "s"), (None, "", "t"), (4, "one more text that stands alone here", "t")]
    docs = spark.createDataFrame([(*r, *CLASHING) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING))
    out, none = run(spark, docs, SF), run(spark, docs.limit(0), SF)
    got = out.collect()
    assert none.collect() == [] and len(got) > 0
    if name != "tokens":
        assert out.columns == docs.columns and all(tuple(r)[3:] == tuple(CLASHING) for r in got)
        assert any(r.text == long for r in got)


def test_run_over_documents(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 50
