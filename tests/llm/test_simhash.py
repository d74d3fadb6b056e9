import random
from collections import Counter

import xxhash

from cartulary.llm.simhash import ball_links, fingerprint, simhash_dedup, simhash_groups
from cartulary.llm.common import components

from .odd import odd, texts


def slow_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, near):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if near(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_fingerprints_agree_with_the_plain_rule(spark):
    for text in ("", "one", "One two", "a b c", "a b a b a b", "x " * 300 + "y z É é", *(t for _, t in texts())):
        assert fingerprint(text.encode()) == slow_fingerprint(text)
    assert spark.sql("select xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_join_all_within_two_bits(spark):
    draw = random.Random(8)
    base = [draw.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, 1 << 63]
    fps = set(base)
    for f in base:
        for n in (1, 2, 2, 3, 4):
            for _ in range(3):
                for b in draw.sample(range(64), n):
                    f ^= 1 << b
                fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = ball_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all((a ^ b).bit_count() <= 2 or ((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in links.collect())
    found = {r["node"]: r["root"] for r in components(links).collect()}
    wanted = slow_components(signed, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    assert {f: found.get(f, f) for f in signed} == wanted


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 7 for i in range(1000, 1200))


def test_groups_of_odd_rows(spark):
    found = Counter(map(tuple, simhash_groups(odd(spark)).collect()))
    fps = {t: slow_fingerprint(t) for _, t in texts()}
    root = slow_components(list(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in texts():
        if i is not None:
            r = root[fps[t]]
            least[r] = min(i, least.get(r, i))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    assert found == Counter((i, signed(fps[t]), least.get(root[fps[t]])) for i, t in texts())


def test_one_row_of_each_group_stays(spark):
    docs = odd(spark)
    groups = {r["component_id"] for r in simhash_groups(docs).collect()}
    kept = simhash_dedup(docs)
    assert kept.schema == docs.schema and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, groups))
    assert simhash_dedup(odd(spark, [])).count() == simhash_groups(odd(spark, [])).count() == 0
