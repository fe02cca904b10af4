import re

from quillspark.llm import quality_rules as R

TEXTS = ["", None, "a b c", "one two three one two three", "x x x x x x", "é ü ß 日本\t語", "line\nline\n\n \nline\nother line\nother line", "# * $ a|b <p>", "  lead\u000b\u000ctrail \r\n", "same words " * 40, "a" * 5000 + " " + "b " * 3000, "A B C D " * 30, "w1 w2 w3 w4\nw1 w2 w3\nw2 w3 w4"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    mark = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            mark |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(mark)


def test_measures_match_brute_force(spark):
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000], "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in R.query(docs).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        n_words, word_chars, n_symbols, dup, rep = brute(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n_words, word_chars, n_symbols, dup, rep), t
        assert r.base_failed == (n_words < 50 or 100 * rep > 50 * n_words)
        assert not (r.base_failed and r.kept)


def test_filter_keeps_columns_and_agrees_with_query(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    rows = [(1, prose, "a", 5), (2, "short", "a", 1), (3, None, None, None), (4, prose.upper(), "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, failed string, n_words int")
    kept = R.filter_documents(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect()] == [1]
    assert [r.doc_id for r in R.query(docs).where("kept").collect()] == [1]


def test_ablation_counts(spark):
    prose = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, prose), (2, "short"), (3, prose.upper()), (4, "A " * 60)], "doc_id long, text string")
    got = {r.rule: r for r in R.ablation(R.ledger(R.measure(docs))).collect()}
    assert got["few_words"].n_failed == 1
    assert got["shouting"].n_failed == 2 and got["shouting"].n_only == 1 and got["shouting"].n_kept_without == 2
    assert got["symbols"].n_kept_without == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert R.query(docs).count() == 0 and R.ablation(R.ledger(R.measure(docs))).count() == 0
