import zlib
from hashlib import sha256

import pytest

from quillspark.llm import merkle_manifest as M

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, _g int, path string"


def H(s):
    return sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H("".join(map(part, (doc_id, source, lang, n_chars, text))))


def climb(nodes):
    """(root, [(left siblings, right siblings) of each level] of each node)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // 8 * 8
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        at = [i // 8 for i in at]
        level = [H("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        forged = text if text is None or not bad else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault("" if lang is None else "=" + lang, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, text, lang, source, n_chars), leaf(doc_id, forged, lang, source, n_chars), doc_id))
    order = sorted(groups, key=str.encode)
    trees = [climb([r[2] for r in sorted(groups[g])]) for g in order]
    root, above = climb([t[0] for t in trees])
    out = []
    for g, (sub, paths), up in zip(order, trees, above):
        for (_, _, own, now, doc_id), path in zip(sorted(groups[g]), paths):
            for left, right in path + up:
                now = H(left + now + right)
            out.append((doc_id, own, sub, root, H("".join(x + y for x, y in path + up)), now, now == root))
    return sorted(out, key=str)


def rows_of(spark, rows):
    got = M.query(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    return sorted((tuple(r) for r in got), key=str)


def row(i, text="Some Text", lang="en", source="s", n_chars=9):
    return (i, text, lang, source, n_chars, "x", 1, "y")


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9, None: 65}, {"en": 7, "é": 1, "zz": 2, "Z": 64, "": 3}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_against_brute_force(spark, sizes):
    rows = [row(i * 100 + k, f"Text {i} of {k}", lang) for i, (lang, n) in enumerate(sizes.items()) for k in range(n)]
    assert rows_of(spark, rows) == brute(rows)


def test_nulls_ties_and_long_texts(spark):
    rows = [row(3, None), row(None, "X"), row(None, "Y", None), row(5, "", None, None, None), row(7, "É A" * 300_000), row(-4), row(2**62, "ABC", "fr")]
    assert rows_of(spark, rows) == brute(rows)
    same = rows_of(spark, [row(1)] * 20 + [row(1, "other")] * 3)
    assert len(same) == 23 and len({r[3] for r in same}) == 1


def test_empty_and_one(spark):
    assert rows_of(spark, []) == []
    [one] = rows_of(spark, [row(2)])
    assert one[1] == one[2] == one[3] and one[4] == H("")


def test_capitals_give_tampering_away(spark):
    rows = [row(i) for i in range(100)]
    for doc_id, *_, verified in rows_of(spark, rows):
        assert verified == (zlib.crc32(str(doc_id).encode()) % 3 != 0)


def test_a_proof_stands_alone(spark):
    rows = [row(i, f"t{i}", "en" if i % 2 else "de") for i in range(90)]
    got = M.manifest(spark.createDataFrame(rows, SCHEMA), fanout=3).collect()
    for r in got:
        node = r["leaf"]
        for s in r["path"]:
            node = H(s["left"] + node + s["right"])
        assert node == r["root"] and max(len(s["left"] + s["right"]) for s in r["path"]) <= 128
