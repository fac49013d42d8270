"""The manifest beside a tree built by plain loops."""

import hashlib
import zlib

from ravelin.llm.merkle_manifest import ARITY, BLOCK, Appender, fold, levels_of, manifest
from tests.llm.brute import LOWER


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grown(nodes):
    """Root, and per node the witness as (left, right) pairs."""
    level, at, steps = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(level) > 1:
        for i, place in enumerate(at):
            first = place - place % ARITY
            steps[i].append(("".join(level[first:place]), "".join(level[place + 1:first + ARITY])))
        level = [sha("".join(level[i:i + ARITY])) for i in range(0, len(level), ARITY)]
        at = [p // ARITY for p in at]
    return level[0], steps


def expected(docs):
    groups = {}
    for row in docs:
        groups.setdefault((row[1] is not None, (row[1] or "").encode()), []).append(row)
    if not docs:
        return []
    trees = {}
    for key, rows in groups.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[key] = (rows, *grown([leaf(r) for r in rows]))
    order = sorted(trees)
    root, upper = grown([trees[k][1] for k in order])
    out = []
    for k, above in zip(order, upper):
        rows, top, steps = trees[k]
        for row, own in zip(rows, steps):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].translate(LOWER))
            folded = leaf(changed)
            for a, b in own + above:
                folded = sha(a + folded + b)
            out.append((row[0], leaf(row), top, root, sha("".join(a + b for a, b in own + above)), folded, folded == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def check(spark, docs):
    found = [tuple(r) for r in manifest(spark.createDataFrame(docs, SCHEMA)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected(docs)))


def test_groups_beyond_one_block_and_many_groups(spark):
    docs = [(i, "big", "en" if i % 3 else None, i, f"Text {i}") for i in range(BLOCK + 700)]
    docs += [(i, f"s{i % 40}", None, None, f"t{i}") for i in range(100)] + [(i, "one block", "x", 1, "Ab") for i in range(BLOCK)]
    check(spark, docs)


def test_nulls_repeats_and_lone_rows(spark):
    row = (7, "a", "en", 3, "Ab")
    check(spark, [row, row, row, (None, "a", None, None, None), (7, "a", "en", 3, ""), (1, None, "é", 0, "É🙂"), (2, "", "", 0, "x:1-"), (3, "z", None, None, "Q")])
    check(spark, [(5, "only", None, None, None)])
    check(spark, [])


def test_streamed_witnesses_equal_those_of_the_whole_tree():
    for count in (1, 2, 15, 16, 17, 255, 256, 257, 1000):
        nodes = [sha(str(i)) for i in range(count)]
        tree = Appender(levels_of(count))
        for node in nodes:
            tree.append(node)
        root, steps = grown(nodes)
        assert tree.finish() == root
        assert [tree.witness(i) for i in range(count)] == steps
        assert all(fold(n, s) == root for n, s in zip(nodes, steps))
        assert count == 1 or fold(sha("other"), steps[0]) != root
