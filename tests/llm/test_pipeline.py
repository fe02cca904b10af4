import hashlib
import re

import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402
import numpy as np  # noqa: E402
from test_decontamination import fold  # noqa: E402
from test_metric_join import brute as groups  # noqa: E402

from quillspark.llm import decontamination as D  # noqa: E402
from quillspark.llm import quality_rules as R  # noqa: E402


def stripped(rows, length=50):
    low = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            k = raw[i : i + length]
            low[k] = min(low.get(k, d), d)
    out = {}
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if low[raw[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        out[d] = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
    return out


def leaks(text, items):
    """Is a window of an item in the text, by the full edit table of each?"""
    t = np.frombuffer(fold(text), np.uint8)
    ramp = np.arange(len(t) + 1)
    for item in items:
        f = fold(item).strip(b" ")
        if len(f) < D.Q:
            continue
        for s in dict.fromkeys([*range(0, max(len(f) - D.WINDOW, 0), D.WINDOW // 2), max(len(f) - D.WINDOW, 0)]):
            w = np.frombuffer(f[s : s + D.WINDOW], np.uint8)
            row = np.zeros(len(t) + 1, np.int64)
            for i, x in enumerate(w, 1):
                new = np.concatenate([[i], np.minimum(row[:-1] + (t != x), row[1:] + 1)])
                row = np.minimum.accumulate(new - ramp) + ramp
            if row.min() <= max(min(int(D.EDITS * len(w)), len(w) // D.Q - 1), 0):
                return True
    return False


def keeps(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    mark = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup, letters, upper = len(lines) - len(set(lines)), len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text))
    chars = sum(map(len, words))
    return not (
        len(words) < 50 or 100 * len(mark) > 50 * len(words) or 100 * len(re.findall(r"[#*$%&|<>]", text)) > 30 * len(words)
        or len(lines) >= 4 and 100 * dup > 60 * len(lines) or chars < 2 * len(words) or chars > 25 * len(words) or letters >= 50 and 100 * upper > 70 * letters
    )


def test_run_matches_brute_force(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{source}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect() if keeps(r.text or "")]
    rows = [(d, t) for d, t in rows if d in {a for a, _, b in groups(rows, 5, 80) if a == b}]
    texts = stripped(rows)
    items = [t for _, t in items]
    whole = [fold(t).strip(b" ") for t in items]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, source).collect()}
    gone = set(texts) - set(got)
    # every text with a whole item goes; the full table confirms those that went and every ninth that stayed
    assert set(got) <= set(texts) and {d for d, t in texts.items() if any(w in fold(t) for w in whole)} <= gone
    assert all(leaks(texts[d], items) for d in gone)
    assert not any(leaks(texts[d][:4000], items) for d in sorted(got)[::9])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for d, r in got.items():
        ids = library.encode(texts[d])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_keep_columns_and_survive_odd_rows(spark):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, " \n", None, "s", 2, "x"), (3, "word " * 20000, "en", "s", 100000, "x")]
    rows += [(i, " ".join(f"w{i % 3}v{j}" for j in range(70)), "en", None, 300, "x") for i in (4, 5, 6, 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, failed string")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, "/root/testdata/sf0.001")
            n = out.count()
            assert n <= table.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "decontamination", "piece_encoding"]
    assert R.POLICIES["v1"][:2] == R.POLICIES["base"]
