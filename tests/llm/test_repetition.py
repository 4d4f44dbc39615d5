import random
import re

from quernstone.llm import repetition


def brute(text, least_words=8, max_covered=0.3, free_words=60, max_longest=0.2):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    covered, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        if best >= least_words:
            longest = max(longest, best)
            covered |= set(range(i, i + best))
    failed = n < 50 or 100 * len(inside) > 50 * n
    kept = not failed and len(covered) <= max_covered * n and longest <= max(free_words, max_longest * n)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(inside), "base_failed": failed, "kept": kept, "covered_words": len(covered), "longest_repeat": longest}


def test_against_brute_force(spark, folder, rows):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a", "a a a", "é é é é", "x " * 90, "one two three four five six seven eight nine ten " * 9]
    for n in range(60):
        words = [rng.choice("ab" if n % 3 == 0 else "abcdefghé#|") * rng.randint(1, 3) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            i, j, k = (rng.randint(0, len(words)) for _ in range(3))
            words[i:i] = words[min(j, k) : max(j, k)]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\x0b"]) for w in words))
    texts += texts[-3:]
    path = folder(list(enumerate(texts)))
    got = repetition.op5_repetition(spark, path).collect()
    assert len(got) == len(texts)
    for r in got:
        r = r.asDict()
        i = r.pop("doc_id")
        assert r == brute(texts[i]), (i, texts[i])


def test_empty_table(spark, folder):
    assert repetition.op5_repetition(spark, folder()).count() == 0


def test_clean_text_is_kept_and_repeated_passages_go(spark, folder):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    clean = " ".join(word() for _ in range(400))
    passage = " ".join(word() for _ in range(100))
    path = folder([(1, clean), (2, f"{clean} {passage} and {passage} or {passage}")])
    kept = {r.doc_id: r.kept for r in repetition.op5_repetition(spark, path).collect()}
    assert kept == {1: True, 2: False}
