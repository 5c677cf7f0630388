"""Plain versions of the operators, for small inputs."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer


def pieces(rows, path, size=2048):
    t = Tokenizer.from_file(path)
    out = []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % size or size
        for k, lo in enumerate([0, *range(first, len(ids), size)]):
            own = ids[lo : first + k * size]
            out.append((doc_id, k, lo, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


def top(vectors, k=20):
    sound = {(i, tuple(v)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    whole = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in sound]
    out = []
    for i, v in whole:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


def repeats(rows, size=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + size] for _, b in data for p in range(len(b) - size + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = int(np.sum(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in low:
        if c == " " or "\t" <= c <= "\r":
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def runs(text, k):
    w = words(text)
    return [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def simhash(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def hashed(text, k):
    return [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs(text, k)]


def near(rows, k=3, radius=2):
    """(doc_id, fingerprint, component), by comparing all pairs of fingerprints."""
    fps = [simhash(hashed(t, k)) for _, t in rows]
    every = sorted(set(fps))
    group = {f: f for f in every}

    def root(f):
        while group[f] != f:
            f = group[f]
        return f

    for n, a in enumerate(every):
        for b in every[n + 1 :]:
            if (a ^ b).bit_count() <= radius:
                group[root(b)] = root(a)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        r = root(f)
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    return [(i, f"{f:016x}", least[root(f)]) for (i, _), f in zip(rows, fps, strict=True)]


def perspectives(rows, part=64):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        who = re.sub(r"[\x00-\x20\x7f]+", " ", (role or "").replace("<|im_start|>", "<|im_start |>").replace("<|im_end|>", "<|im_end |>")).strip(" ") or "unknown"
        say = (text or "").replace("<|im_start|>", "<|im_start |>").replace("<|im_end|>", "<|im_end |>")
        talks[conv].append((turn is None, turn or 0, who, say))
    out = []
    for conv, said in talks.items():
        said.sort()
        for speaker in {x[2] for x in said} - {"system"}:
            for p in range(0, len(said), part):
                text, mask = "", []
                for _, _, who, say in said[p : p + part]:
                    text += "<|im_start|>" + ("assistant" if who == speaker else who if who == "system" else f"user name={who}") + "\n"
                    if who == speaker:
                        mask.append(f"{len(text)}-{len(text) + len(say) + len('<|im_end|>')}")
                    text += say + "<|im_end|>\n"
                out.append((conv, speaker, p // part, len(said[p : p + part]), text, ",".join(mask)))
    return out


def line_dedup(rows, long=50):
    """(doc_id, lines removed, text left) of rows of unique ids, by pairs of neighbouring lines and long single ones."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        passages = [(k, (x, y)) for k, (x, y) in enumerate(zip(lines, lines[1:], strict=False)) if x.strip() or y.strip()]
        passages += [(k, (x,)) for k, x in enumerate(lines) if len(x.split()) > long]
        for k, body in passages:
            if body in seen:
                gone.update(range(k, k + len(body)))
            seen.add(body)
        out.append((i, len(gone), t if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def leaks(rows, items, k=5, radius=20, similarity=0.8):
    """(doc_id, item_id, similarity, start, words, distance): every window of every text against every item."""
    out = []
    for i, t in rows:
        own, best = words(t), {}
        for item, body in items:
            want = words(body)
            if item is None or not want or not own:
                continue
            if len(want) < k:
                at = [p for p in range(len(own) - len(want) + 1) if own[p : p + len(want)] == want]
                if at:
                    best[item] = max(best.get(item, ()), (1.0, -at[0], len(want), 0))
                continue
            if len(own) < k:
                continue
            target, fp = Counter(hashed(body, k)), simhash(hashed(body, k))
            h = hashed(t, k)
            m = min(len(h), len(want) - k + 1)
            for p in range(len(h) - m + 1):
                both = sum((Counter(h[p : p + m]) & target).values())
                sim = both / (m + sum(target.values()) - both)
                if sim >= similarity and (far := (simhash(h[p : p + m]) ^ fp).bit_count()) <= radius:
                    best[item] = max(best.get(item, ()), (sim, -p, m + k - 1, far))
        out += [(i, item, round(s, 9), -p, n, far) for item, (s, p, n, far) in best.items()]
    return out


def archived(rows):
    lead = {}
    for i, html in rows:
        lead.setdefault(html or "", []).append(i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        most = max((x for x in lead[html or ""] if x is not None), default=None)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == most else "revisit", None if i == most else most))
    return out


def near_copies(rows):
    """(id is null, id) of the document that stays of each group of near copies, by comparing all pairs of sets."""
    sets = [frozenset(runs(t, 5)) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    return sorted(least.values())


def repeated_runs(rows, long=50):
    """(doc_id, text left): every run of lines, of every length, is looked up among all runs that start before."""
    seen, out = set(), []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if (b - a == 1 and len(lines[a].split()) <= long) or any(not x.strip() and not y.strip() for x, y in zip(run, run[1:], strict=False)):
                    continue
                if run in seen:
                    gone.update(range(a, b))
                seen.add(run)
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out
