"""Small made-up texts for the tests."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append(rng.choice(WORDS) + rng.choice(WORDS)[: rng.randrange(4)])
        if rng.random() < 0.1:
            out[-1] += rng.choice([".", ".\n", ",", "  "])
    return " ".join(out)
