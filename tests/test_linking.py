"""Candidates above the cap against the reference's rule, without its sampling."""

import random
import re

import pytest

from corpusloom.operators import linking


def brute(text, concepts, cap):
    where = {}
    for c, label in concepts:
        for t in set(re.findall("[a-z0-9]{2,}", label)):
            where.setdefault(t, set()).add(c)
    known = sorted((t for t in re.findall("[a-z0-9]{2,}", text) if t in where), key=lambda t: len(where[t]))
    if len(known) < 2:
        return where[known[0]] if known else set()
    found = where[known[0]] & where[known[1]]
    for t in known[2:]:
        if len(found) <= cap:
            break
        found = found & where[t]
    return found or where[known[0]] | where[known[1]]


@pytest.mark.parametrize("cap", [2, 5, 1000])
def test_candidates_narrow_by_further_tokens(spark, cap):
    rng = random.Random(1)
    tokens = ["aa", "bb", "cc", "dd", "ee", "ff"]
    concepts = [(i, " ".join(sorted(rng.sample(tokens, rng.randint(1, 5))))) for i in range(60)] + [(99, "aa bb cc dd ee ff")]
    mentions = [(i, " ".join(rng.sample(tokens, rng.randint(1, 6)))) for i in range(40)] + [(50, "zz"), (51, "aa"), (52, "aa bb cc dd ee ff")]
    got = linking.candidates(spark.createDataFrame(mentions, "mention long, text string"), "mention", "text", spark.createDataFrame(concepts, "concept long, label string"), "concept", "label", cap).collect()
    want = {(m, c) for m, text in mentions for c in brute(text, concepts, cap)}
    assert sorted((r.mention, r.concept) for r in got) == sorted(want)
    assert (52, 99) in want
