"""The stages in plain Python: the brute force that tests compare with."""

import math
import zlib
from collections import Counter

from loomframe.llm import toxicity


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def quality_score(model, text):
    """The model's score from its n-grams, one by one."""
    buckets, mask = len(model.weights), 2**64 - 1
    words, total, n = (text or "").split(), 0.0, 0
    for k, word in enumerate(words):
        marked = f"<{word}>"
        rows = [zlib.crc32(marked.encode("utf-8", "replace"), 7) % buckets]
        for size in (2, 3, 4):
            for i in range(len(marked) - size + 1):
                h = size
                for c in marked[i : i + size]:
                    h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & mask
                    h ^= h >> 29
                rows.append((h >> 16) % buckets)
        if k and words[k - 1] == word:
            rows.append(zlib.crc32(b"<repeated>", 7) % buckets)
        total += sum(float(model.weights[r]) for r in rows)
        n += len(rows)
    z = model.bias + (total / n if n else 0.0)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def toxicity_scores(texts, labels, little=0.05, enough=26, k=15, prior=0.5):
    """{id: (score, similarities, tie)} of {id: text} with {id: 0 or 1}; tie: whether the last neighbour isn't unique."""
    counts = {i: Counter(toxicity.words_of(t or "")) for i, t in texts.items()}
    examples = [i for i in sorted(labels) if i in texts and fold(i, 5) != 0]
    n, hits, df = Counter(), Counter(), Counter()
    for i in examples:
        n.update(counts[i].keys())
        hits.update(counts[i].keys() if labels[i] else ())
    for c in counts.values():
        df.update(c.keys())
    total, ones = len(examples), sum(labels[i] for i in examples)

    def weight(t):
        part = lambda x, p: x * math.log(x / (n[t] * p)) if x else 0.0
        share = ones / total
        evidence = 2 * (part(hits[t], share) + part(n[t] - hits[t], 1 - share)) if hits[t] > n[t] * share else 0.0
        return (math.log((1 + len(texts)) / (1 + df[t])) + 1) * (little + (1 - little) * min(1.0, (evidence / enough) ** 2))

    weights = {t: weight(t) for t in n}
    unit = {}
    for i, c in counts.items():
        v = {t: (1 + math.log(m)) * weights[t] for t, m in c.items() if t in n}
        norm = math.sqrt(sum(w * w for w in v.values()))
        unit[i] = {t: w / norm for t, w in v.items()} if norm else {}
    base = (ones + 1) / (total + 2)
    bare = [labels[i] for i in examples if not unit[i]]
    out = {}
    for i, own in unit.items():
        sims = sorted(((round(sum(w * unit[e].get(t, 0) for t, w in own.items()), 12), e) for e in examples), reverse=True)
        sims = [(s, e) for s, e in sims if s > 0]
        near = sims[:k]
        score = (
            sum(s for s, e in near if labels[e]) + prior * base
        ) / (sum(s for s, _ in near) + prior) if near else (sum(bare) + 2 * base) / (len(bare) + 2)
        out[i] = score, [s for s, _ in near], len(sims) > k and sims[k - 1][0] - sims[k][0] < 1e-9
    return out


def drop_lines(rows, ratio=0.1, least=2):
    """[(host, text)] to [(text, lines, dropped)]."""
    total, on = Counter(), Counter()
    for host, text in rows:
        total[host] += 1
        if text is not None:
            on.update((host, line) for line in set(text.split("\n")) if line.strip(" "))
    out = []
    for host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not x.strip(" ") or on[host, x] < least or on[host, x] <= ratio * total[host]]
        out.append((None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def near_copies(rows):
    """[(id, text)]: the ids that stay, the least of each component over the Jaccard similarity of five-word shingles."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) < 4 * max(len(sets[i]), len(sets[j])):
                continue
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(least.values())


def pieces(tokenizer, doc_id, text, capacity=1024, end=2):
    """(doc_id, piece, start, length, crc) by the library."""
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
    first = len(ids) if len(ids) <= capacity else len(ids) % capacity
    cuts = ([(0, first)] if first else []) + [(s, capacity) for s in range(first, len(ids), capacity)]
    return [(doc_id, k, s, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s : s + n]))) for k, (s, n) in enumerate(cuts)]
