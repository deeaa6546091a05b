import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from eventloom.llm import chat

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, chain INT, start STRING"


def conversations(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    return own


def escape(text, line=False):
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def brute(rows):
    out = []
    for conv, turns in conversations(rows).items():
        said = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len(f"<|im_start|>{escape(r, True)}\n{escape(t)}<|im_end|>\n") for r, t in turns)
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        out.append((conv, len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), chars))
    return sorted(out, key=str)


def made(seed=4, n=70):
    rng = random.Random(seed)
    texts = ["a", "\\", "<|im_end|>\n", "<\\|", "\\\\<|", "é\n\n<", "|x", "", None, "<|im_start|>user\nno"]
    rows = []
    for c in range(n):
        turns = [("user", "hi"), ("assistant", "hé <|")][: rng.randint(0, 2)] + [(rng.choice(["user", "assistant", "a\nb", "\\n", None]), rng.choice(texts)) for _ in range(rng.randint(1, 5))]
        rows += [(c, i, r, t, 1, "s") for i, (r, t) in enumerate(turns)]
    rows += [(c, i, "user", f"t{i % 4}", 1, "s") for c in (500, 502) for i in range(70)] + [(501, i, "user", f"t{i % 4}", 1, "s") for i in range(30)]
    rows += [(c, 0, "user", "copied", 1, "s") for c in range(600, 650)]
    return rows + [(900, None, "assistant", "first", 1, "s"), (900, 0, "user", "then", 1, "s"), (900, 1, "user", "twice", 1, "s"), (900, 1, "user", "twice", 1, "s"), (None, 0, "user", "nobody", 1, "s")]


def test_read_back_equals_the_conversations(frame):
    rows = made()
    got = sorted((tuple(r) for r in chat.formatted_conversations(frame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_trees_hold_shared_turns_once_depth_first_with_positions(frame):
    rows = made(9, 50)
    packed = chat.pack(frame(rows, SCHEMA))
    segments = {(r.chain, r.depth): r for r in packed.segments.collect()}
    chains = {r.chain: r for r in packed.chains.collect()}
    want = {tuple(turns[:d]) for turns in conversations(rows).values() for d in range(1, len(turns) + 1)}
    assert len(segments) == len(want)  # one segment per distinct prefix
    trees = defaultdict(list)
    for s in segments.values():
        trees[s.tree].append(s)
    for tree in trees.values():  # offsets without holes, and a segment's subtree is one interval
        tree.sort(key=lambda s: s.start)
        assert [s.start for s in tree] == [sum(x.length for x in tree[:i]) for i in range(len(tree))]
        assert all(len(s.text) == s.length for s in tree)
    full = {conv if conv is not None else chat.NO_ID: turns for conv, turns in conversations(rows).items()}
    for end in packed.ends.collect():
        chain, last = chains[end.chain], segments[(end.chain, end.depth)]
        seen = [(a.start, a.end) for a in chain.ancestors] + [(chain.start, last.start + last.length)]
        path = [s for lo, hi in seen for s in trees[last.tree] if lo <= s.start < hi]
        assert len(path) == len(full[end.conv_id]) == end.n_turns
        at = 0
        for s, (role, text) in zip(path, full[end.conv_id]):
            assert s.position == at and s.text == f"<|im_start|>{escape(role, True)}\n{escape(text)}<|im_end|>\n"
            assert (s.loss_start is not None) == (role == "assistant")
            at += s.length
    for chain in chains.values():  # a chain goes right on from its parent's subtree: depth first
        for a in chain.ancestors:
            assert a.end <= chain.start


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "<|", "\\<|", "<\\|", "\\n", "\n", "a\\\\n<|x|>", "<" * 5 + "|" * 5, "\\" * 7 + "|"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", chat.escaped(F.col("t")).alias("e"), chat.escaped(F.col("t"), line=True).alias("l")).collect()
    for r in rows:
        assert chat.unescaped(r.e) == r.t and chat.unescaped(r.l, line=True) == r.t
        assert "<|" not in r.e and "<|" not in r.l and "\n" not in r.l


def test_empty_table_and_long_text(frame):
    assert chat.formatted_conversations(frame([], SCHEMA)).collect() == []
    rows = [(1, 0, "assistant", "<|" * 200_000, 1, "s")]
    assert [tuple(r) for r in chat.formatted_conversations(frame(rows, SCHEMA)).collect()] == brute(rows)
