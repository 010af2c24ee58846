"""Checks of the corpus queries in DuckDB SQL."""

from __future__ import annotations

from pricelens.llm.license_scan import NOTICES, PHRASES

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_scan() -> str:
    grams = ", ".join(
        f"({i}, '{t.label}', {len(t.words()) - 1}, {t.exact}, {p}, '{t.words()[p]}', '{t.words()[p + 1]}')"
        for i, t in enumerate(PHRASES + NOTICES) for p in range(len(t.words()) - 1)
    )
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS w
  FROM documents),
g(template, label, n_grams, exact, tpos, a, b) AS (VALUES {grams}),
p AS (SELECT doc_id, unnest(range(len(w) - 1)) AS pos, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM d WHERE len(w) > 1),
v AS (
  SELECT doc_id, template, label, n_grams, exact, pos - tpos AS diagonal, count(*) AS votes,
    list(tpos) AS tposes, min(pos) AS lo, max(pos) + 1 AS hi
  FROM p JOIN g USING (a, b) GROUP BY ALL),
x AS (SELECT doc_id, label, diagonal AS start FROM v WHERE exact AND votes = n_grams),
l AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS gap
  FROM v WHERE NOT exact AND (votes > 1 OR n_grams < 4)),
r AS (
  SELECT *, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM l),
m AS (
  SELECT doc_id, template, label, n_grams, run, min(lo) AS lo, max(hi) AS hi,
    len(list_distinct(flatten(list(tposes)))) * 1.0e0 / n_grams AS coverage
  FROM r GROUP BY doc_id, template, label, n_grams, run),
s AS (
  SELECT doc_id, label, TRUE AS exact, start, 1.0e0 AS coverage FROM x
  UNION ALL SELECT doc_id, label, FALSE, NULL, coverage FROM m WHERE coverage >= 0.6 AND hi - lo < 1.5 * (n_grams + 1)),
f AS (
  SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(start) AS first_word, max(start) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact), '') AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0e0) AS score
FROM d LEFT JOIN f USING (doc_id)"""


def centroids(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    """Every distance is computed here; integers throughout.  Repeated rows are told apart by r."""
    def nearest(r: int) -> str:
        return f"""
a{r} AS MATERIALIZED (
  SELECT r, min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c.cluster}}) AS best
  FROM v, c{r} AS c GROUP BY r)"""

    def after(r: int) -> str:
        return f"""
s{r} AS (SELECT a.best.c AS cluster, unnest(v.x) AS x, unnest(range({dims})) AS i FROM a{r} AS a JOIN v USING (r)),
m{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM s{r} GROUP BY cluster, i),
q{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(q.x, c.x) AS x FROM c{r} AS c LEFT JOIN q{r} AS q USING (cluster))"""

    steps = ",".join(nearest(r) + "," + after(r) for r in range(rounds))
    return f"""
WITH e AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM e),
h AS (SELECT *, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS nth FROM v),
c0 AS MATERIALIZED (SELECT CAST(nth AS INTEGER) AS cluster, x FROM h WHERE nth < {k}),{steps},{nearest(rounds)},
t AS (SELECT best.c AS cluster, CAST(sum(best.d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY best.c),
w AS (SELECT CAST(sum(best.d) AS BIGINT) AS inertia FROM a{rounds})
SELECT v.vec_id, a.best.c AS cluster, CAST(a.best.d AS BIGINT) AS distance, t.cluster_inertia, w.inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN v USING (r) JOIN t ON t.cluster = a.best.c JOIN c{rounds} AS c ON c.cluster = a.best.c, w"""


def merkle(tree_levels: int = 6, group_levels: int = 2, arity: int = 16) -> str:
    """All levels unrolled: enough for groups of 16^6 rows and 16^2 groups.  ``n`` counts a
    tree's nodes on the level; a tree of one node stays as it is."""
    def climb(name: str, base: str, levels: int) -> str:
        """name0 .. name<levels>: tree, pos, node, n, and the run's joined nodes for the proofs."""
        steps = [f"{name}0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {base})"]
        for k in range(levels):
            steps.append(f"""
{name}r{k} AS MATERIALIZED (
  SELECT tree, pos // {arity} AS pos, string_agg(node, '' ORDER BY pos) AS joined, any_value(n) AS n FROM {name}{k} GROUP BY tree, pos // {arity}),
{name}{k + 1} AS MATERIALIZED (
  SELECT tree, pos, CASE WHEN n = 1 THEN joined ELSE sha256(joined) END AS node, count(*) OVER (PARTITION BY tree) AS n FROM {name}r{k})""")
        return ",".join(steps)

    def path(name: str, pos: str, tree: str, levels: int) -> list[tuple[str, str, str]]:
        """Per level: the join, the siblings, and the fold of the level before."""
        out = []
        for k in range(levels):
            r, place = f"{name}j{k}", f"({pos} // {arity ** k}) % {arity}"
            before, behind = f"substr({r}.joined, 1, 64 * ({place}))", f"substr({r}.joined, 64 * ({place}) + 65)"
            joins = f"JOIN {name}r{k} AS {r} ON {r}.tree = {tree} AND {r}.pos = {pos} // {arity ** (k + 1)}"
            siblings = f"CASE WHEN {r}.n = 1 THEN '' ELSE {before} || {behind} END"
            folded = f"CASE WHEN {r}.n = 1 THEN f.folded ELSE sha256({before} || f.folded || {behind}) END"
            out.append((joins, siblings, folded))
        return out

    def field(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"

    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # every level's fold in a step of its own: nested they would double from level to level
    inner = path("t", "f.pos", "f.tree", tree_levels)
    upper = path("u", "f.upos", "'*'", group_levels)
    steps, last = [], "base"
    for k, (join, siblings, folded) in enumerate(inner + upper):
        steps.append(f"""
f{k} AS MATERIALIZED (
  SELECT f.* EXCLUDE (folded, proof), {folded} AS folded, f.proof || {siblings} AS proof FROM {last} AS f {join})""")
        last = f"f{k}"
    # CRC-32 bit by bit over the id's decimal digits
    crc = f"""list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
    return f"""
WITH l AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree, sha256({head} || {field("text")}) AS node,
    CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN sha256({head} || {field(low)}) ELSE sha256({head} || {field("text")}) END AS seen
  FROM documents),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM l),
{climb("t", "(SELECT tree, pos, node FROM b)", tree_levels)},
g AS MATERIALIZED (SELECT tree AS of, node AS subroot, '*' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM t{tree_levels}),
{climb("u", "(SELECT tree, pos, subroot AS node FROM g)", group_levels)},
base AS (
  SELECT b.doc_id, b.node AS leaf, g.subroot, g.pos AS upos, b.tree, b.pos, b.seen AS folded, '' AS proof
  FROM b JOIN g ON g.of = b.tree),{",".join(steps)}
SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.node AS verified
FROM {last}, u{group_levels} AS r"""


def repeated_windows(width: int = 100) -> str:
    """Every window of every text, as hex digits (a hundred windows at a time: slices of
    long texts are slow); spans by islands of covered bytes."""
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {width - 1}, 100)) AS s FROM d WHERE len(h) >= {2 * width}),
o AS (SELECT doc_id, s, h[2 * s + 1:2 * s + {2 * width + 198}] AS h FROM q),
p AS (SELECT doc_id, s, h, unnest(range(len(h) // 2 - {width - 1})) AS i FROM o),
w AS MATERIALIZED (SELECT doc_id, s + i AS i, md5_number(h[2 * i + 1:2 * i + {2 * width}]) AS k FROM p),
f AS (SELECT k, min({{'d': doc_id, 'i': i}}) AS first FROM w GROUP BY k HAVING count(*) > 1),
r AS MATERIALIZED (SELECT doc_id, i FROM w JOIN f USING (k) WHERE f.first <> {{'d': doc_id, 'i': i}}),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {width} THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS start, max(i) + {width} AS stop FROM n GROUP BY doc_id, run),
c AS (SELECT doc_id, start, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS after, stop FROM s),
k AS (
  SELECT doc_id, sum(stop - start) AS n_removed, count(*) AS n_spans, max(stop) AS last,
    string_agg(h[2 * after + 1:2 * start], '' ORDER BY start) AS kept
  FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || h[2 * coalesce(last, 0) + 1:])) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
