"""Deterministic stand-in model parameters for the apply-side operators
(encoder/decoder weights, linear coefficients). They are generated by a rule
so the same numbers can be written into the SQL oracles; a fitted model
(``embed_fit``, MLlib) supplies real ones in the same table shapes."""

from __future__ import annotations

EMB_GROUPS = 4


def emb_group_of(i: int) -> int:
    return i % EMB_GROUPS


def emb_dims(g: int) -> int:
    return 1 if g == 0 else 2


def enc_w(g: int, i: int, d: int) -> float:
    return (((i * 7 + d * 3 + g) % 11) - 5) / 10.0


def enc_b(g: int, d: int) -> float:
    return 0.01 * (d + 1)


def dec_w(g: int, d: int, i: int) -> float:
    return (((i * 5 + d * 2 + g) % 9) - 4) / 10.0


def emb_coef(i: int) -> float:
    return (((i * 3) % 7) - 3) / 10.0


def latent_coef(g: int, d: int) -> float:
    return 0.5 - 0.25 * d + 0.1 * g


DOC_COEFS = {"n_chars": 0.001, "toxic": -0.5, "is_en": 0.2}
