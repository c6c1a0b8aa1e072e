"""Small inputs with every awkward case, and plain versions of the operators to hold them against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __note string, kept boolean, n_lines long, key string, size long, text_sha256 string"
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(6000))
LINE = "This line of more than forty characters stands in many documents."
PASSAGE = "a passage of well over fifty bytes that several documents hold in the midst of other words"


def texts() -> dict[int, str | None]:
    """By id: nulls, empties, ties, copies, near copies, shared lines and passages, very long texts."""
    out: dict[int, str | None] = {0: None, 1: "", 2: "  \n\t ", 3: "word", 4: "Word", 5: "Étude étude 🙂 x", 6: "étude étude 🙂 x", 7: LONG, 8: LONG, 9: LONG.replace("word5 ", "other5 "), 10: None, 11: ""}
    for i in range(12, 22):
        own = " ".join(f"own{i}x{k}" for k in range(40))
        out[i] = f"{own}\n{LINE if i % 2 else LINE.upper()}  \n{own[:30]} {PASSAGE} {own[:40]}"
    base = [f"near{k}" for k in range(200)]
    for i in range(22, 30):
        out[i] = " ".join(w if k != i * 3 else f"changed{i}" for k, w in enumerate(base))
    for i in range(30, 40):
        out[i] = "the same text in ten documents, word for word and long enough to count as one"
    out[40] = "\n".join([LINE] * 3 + ["other"])
    out[41] = "ab " * 300
    return out


def frame(spark, rows=None, empty=False):
    rows = [] if empty else [(i, t, "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", len(t or ""), "n", True, 1, "k", 5, "x") for i, t in (rows or texts().items())]
    return spark.createDataFrame(rows, DOCS)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_classes(rows: dict, threshold: float = 0.8) -> dict:
    """(class, links) by id, over all pairs."""
    sets = {i: shingles(t) for i, t in rows.items()}
    parent, links = {i: i for i in rows}, dict.fromkeys(rows, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-12:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in rows}
