"""DuckDB SQL of the mixture, written from its definition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def _level(k: int, levels: Sequence[str], weights: Mapping[tuple, int]) -> str:
    path = list(levels[:k])
    cases = " ".join(f"WHEN {' AND '.join(f"{c} = '{v}'" for c, v in zip(path, p, strict=True))} THEN {w}" for p, w in weights.items() if len(p) == k)
    weight = f"CASE {cases} ELSE 1 END" if cases else "1"
    parent = ", ".join(path[:-1]) or "0"
    cols = ", ".join(path)
    budget = "(SELECT budget FROM l0)" if k == 1 else f"(SELECT p.budget FROM l{k - 1} p WHERE {' AND '.join(f'p.{c} = n.{c}' for c in path[:-1])})"
    return f"""
n{k} AS (SELECT {cols}, sum(s)::BIGINT AS s, ({weight})::BIGINT AS w FROM leaf GROUP BY {cols}),
b{k} AS (SELECT n.*, {budget} AS budget FROM n{k} n),
o{k} AS (SELECT *, coalesce(sum(s) OVER before, 0)::HUGEINT AS s_before, (sum(w) OVER whole - coalesce(sum(w) OVER before, 0))::HUGEINT AS w_left
  FROM b{k} WINDOW whole AS (PARTITION BY {parent}), before AS (PARTITION BY {parent} ORDER BY s::DOUBLE / w, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c{k} AS (SELECT *, s::HUGEINT * w_left <= w::HUGEINT * (budget - s_before) AS short FROM o{k}),
d{k} AS (SELECT *, (budget - sum(CASE WHEN short THEN s ELSE 0 END) OVER p)::HUGEINT AS rest, sum(CASE WHEN short THEN 0 ELSE w END) OVER p AS rest_w FROM c{k} WINDOW p AS (PARTITION BY {parent})),
e{k} AS (SELECT *, CASE WHEN short THEN 0 ELSE (w::HUGEINT * rest // rest_w)::BIGINT END AS part FROM d{k}),
f{k} AS (SELECT *, rest - sum(part) OVER (PARTITION BY {parent}) AS over_, row_number() OVER (PARTITION BY {parent} ORDER BY short, {path[-1]}) AS place FROM e{k}),
l{k} AS (SELECT {cols}, s, w, (CASE WHEN short THEN s ELSE part + CASE WHEN place <= over_ THEN 1 ELSE 0 END END)::BIGINT AS budget FROM f{k}),"""


def mixture_sql(docs: str, level_sql: Mapping[str, str], weights: Mapping[tuple, int], max_epochs: int, seed: int) -> str:
    """Rows (doc_id, domain, lang, source, mix_epoch, mix_tokens, mix_taken) of the mixture of all tokens once."""
    levels = list(level_sql)
    cols = ", ".join(levels)
    named = ", ".join(f"coalesce({e}, '') AS {c}" for c, e in level_sql.items())
    space = "[\\x20\\x09-\\x0D]+"
    return f"""
WITH trimmed AS (SELECT doc_id, {named}, regexp_replace(coalesce(text, ''), '^{space}|{space}$', '', 'g') AS t FROM {docs}),
r AS (SELECT doc_id, {cols}, (CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '{space}')) END)::BIGINT AS tokens FROM trimmed),
leaf AS (SELECT {cols}, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {max_epochs})::BIGINT AS s FROM r GROUP BY {cols}),
l0 AS (SELECT sum(tokens)::BIGINT AS budget FROM leaf),{"".join(_level(k, levels, weights) for k in range(1, len(levels) + 1))}
plan AS (SELECT x.*, y.tokens AS leaf_tokens, CASE WHEN y.tokens > 0 THEN x.budget // y.tokens ELSE 0 END AS epochs FROM l{len(levels)} x JOIN leaf y USING ({cols})),
k AS (SELECT r.*, epochs, budget - epochs * leaf_tokens AS rest, md5('{seed}:' || epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM r JOIN plan USING ({cols})),
q AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {cols} ORDER BY key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k),
e AS (SELECT *, unnest(range(epochs::BIGINT + CASE WHEN start < rest THEN 1 ELSE 0 END)) AS mix_epoch FROM q)
SELECT doc_id, {cols}, mix_epoch::INTEGER AS mix_epoch, tokens AS mix_tokens, (CASE WHEN mix_epoch = epochs THEN least(tokens, rest - start) ELSE tokens END)::BIGINT AS mix_taken FROM e
"""


DOCUMENT_LEVELS_SQL = {"domain": "CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'curated' END", "lang": "lang", "source": "source"}
