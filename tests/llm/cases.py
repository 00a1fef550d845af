"""Small tables with everything that goes wrong in large ones, and plain versions of the operators."""

import hashlib
import re
from itertools import combinations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 13) % 7))
    return " ".join(out)


def odd_texts():
    base = prose(1, 60)
    near = base.replace(base.split()[30], "Changed", 1)
    item = prose(50, 25)
    common = "  This very common line stands in many of the documents here.\t"
    license_line = "Licensed under the Apache License, Version 2.0."
    texts = [
        None, "", " ", "\n\n", "one", "a b c d", "a b c d", "A\tB c D", base, base.upper(), near, near + " end", base[: len(base) // 2],
        "été 中文 \U0001f600 naïve École " * 8, "!!! ??? ...", "<|endoftext|> plain <|endoftext|>", "a  b   c\r\n\td\x0be\x0cf",
        f"intro words\n{license_line}\nmore words", license_line, "permission\n\n" + license_line + "\n\n\n" + "end",
        f"{prose(60, 12)} {item} {prose(61, 12)}", " ".join(item.split()[5:17]).upper(), " ".join(item.split()[:9]), "short item words", "x short, item! words y",
        prose(70, 30_000), "word " * 3000, "\n".join(["Repeated line that is certainly longer than forty code points."] * 4),
    ]
    texts += [f"{prose(100 + k, 8)}\n{common if k % 2 else common.strip().upper()}\n{prose(200 + k, 5)}" for k in range(7)]
    texts += ["é" * 39, "é" * 40, *["é" * 40 + "\nrest"] * 5, *["y" * 39 + "\nrest"] * 6]
    return texts


def odd_items():
    item = prose(50, 25)
    return [(1, item), (2, item), (3, "short, ITEM words"), (4, None), (5, ""), (6, "..."), (10, " ".join(item.split()[5:20])), (7, "item")]


def write(folder, texts, items=None, labels=None):
    n = len(texts)
    pq.write_table(pa.table({
        "doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([None if k % 5 == 0 else "en" for k in range(n)], pa.string()),
        "source": pa.array([None] * n, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
    }), f"{folder}/documents.parquet")
    items = odd_items() if items is None else items
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), f"{folder}/benchmark.parquet")
    labels = [(k, k % 2, None if k % 7 == 0 else int(k % 3 == 0)) for k in range(n)] if labels is None else labels
    pq.write_table(pa.table({
        "doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32()),
    }), f"{folder}/labels.parquet")
    return str(folder)


def connect(folder):
    duck = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return duck


def lowered(text):
    return text.translate({k: k + 32 for k in range(65, 91)})


def lines_plain(rows):
    """rows: (id, text); the smallest id is None."""
    def key(line):
        return lowered(line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(doc)
    keeper = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= 5}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in keeper or keeper[key(line)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def shingles_plain(text, width=5):
    words = re.findall("[^\x20\x09-\x0d]+", lowered(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def groups_plain(rows, width=5):
    """(id, set size, smallest id reached) of rows with different ids."""
    sets = {doc: shingles_plain(text, width) for doc, text in rows}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(doc, len(s), find(doc)) for doc, s in sets.items()]


def hits_plain(rows, items, window=10):
    def words(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text or ""))

    windows = {}
    for name, text in items:
        own = words(text)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add(name)
    out = []
    for doc, text in rows:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if (names := windows.get(tuple(own[k : k + size]))):
                    hit.update(range(k, k + size))
                    found |= names
        out.append((doc, len(own), len(hit), sorted(str(x) for x in found if x is not None)))
    return out
