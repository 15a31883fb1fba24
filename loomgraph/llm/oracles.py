"""SQL of the operators' queries, for an engine that has no part of their code.

It states what the contract asks for by the plainest way, on tables small enough for that.
"""

from __future__ import annotations

from loomgraph.llm import mixing

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def jaccard_join(k: int = 4, percent: int = 85) -> str:
    """All pairs that share a shingle, by what they share; components by their closure."""
    lower = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(lower)} AS w FROM documents),
sh AS (
  SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) END) AS s FROM d),
size AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
alike AS (SELECT min(r) AS r, list(r) AS all_r FROM (SELECT r, md5(string_agg(s, chr(1) ORDER BY s)) AS h FROM sh GROUP BY r) GROUP BY h),
single AS (SELECT sh.* FROM sh JOIN alike USING (r)),
shared AS (SELECT s FROM single GROUP BY s HAVING count(*) > 1),
listed AS (SELECT single.* FROM single JOIN shared USING (s)),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM listed a JOIN listed b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
ends AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r AS a, r AS b FROM alike UNION SELECT reach.a, ends.b FROM reach JOIN ends ON ends.a = reach.b),
low AS (SELECT alike.r, min(doc_id) AS low FROM alike, unnest(all_r) u(m) JOIN d ON d.r = m GROUP BY alike.r),
comp AS (SELECT reach.a AS r, min(low) AS component_id FROM reach JOIN low ON low.r = reach.b GROUP BY reach.a),
members AS (SELECT m AS r, component_id FROM alike JOIN comp USING (r), unnest(all_r) u(m))
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN size USING (r) LEFT JOIN members USING (r)
"""


def substring_dedup(window: int = 35) -> str:
    """Every window by a digest of its words, counted; words that a repeated one covers go."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + j AS i FROM win JOIN rep USING (h), range({window}) t(j)),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word ANTI JOIN gone ON gone.r = word.r AND gone.i = word.i GROUP BY word.r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def _salt(x: str) -> str:
    m = mixing.MODULUS
    return f"(({x}) % {m} * 69621 + 12345) % {m}"


def _salted(value: str, salt: str) -> str:
    m = mixing.MODULUS
    once = f"((({value}) % {m} * 48271 + ({salt})) % {m})"
    return f"((xor({once}, {once} >> 15) * 1597334677 + 715225739) % {m})"


def source_mixing() -> str:
    """Targets by water level; each wanted block's index and slot by their permutations."""
    m = mixing.MODULUS
    weights = ", ".join(map(str, mixing.WEIGHTS))
    by = "OVER (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING)"
    rounds, last = [], "p0"

    def step(r: int, x: str, n: str, seed: str) -> tuple[str, str]:
        """A round's mirror of ``x`` below ``n``, and the image of both."""
        at = f"({seed} % {m} + {r * 7919})"
        point = f"({_salted(at, _salt('17'))} * {m} + {_salted(at, _salt('29'))}) % {n}"
        image = f"CASE WHEN ({_salted(f'greatest({x}, {x}_mirror)', _salt(f'{seed} % {m} + {r * 104729}'))} >> 11) & 1 = 1 THEN {x}_mirror ELSE {x} END"
        return f"({point} - {x} + {n}) % {n} AS {x}_mirror", f"{image} AS {x}"

    for r in range(1, mixing.ROUNDS + 1):
        both = [step(r, "x", "blocks", "seed"), step(r, "place", "all_want", "CAST(29 AS BIGINT)")]
        rounds.append(f"k{r} AS (SELECT *, {', '.join(mirror for mirror, _ in both)} FROM {last})")
        rounds.append(f"p{r} AS (SELECT * EXCLUDE (x, x_mirror, place, place_mirror), {', '.join(image for _, image in both)} FROM k{r})")
        last = f"p{r}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s0),
s2 AS (SELECT *, [{weights}][rank % {len(mixing.WEIGHTS)} + 1] AS weight FROM s1),
s3 AS (SELECT *, CAST({mixing.PASSES} * source_size AS DOUBLE) / weight AS ratio FROM s2),
s4 AS (SELECT *, sum(source_size) OVER () * 150 / 100e0 - (sum(source_size) {by} * {mixing.PASSES} - {mixing.PASSES} * source_size) AS rest, sum(weight) OVER () - sum(weight) {by} + weight AS open_weight FROM s3),
s5 AS (SELECT *, CAST(rest AS DOUBLE) / open_weight AS level FROM s4),
s6 AS (SELECT *, (SELECT level FROM s5 WHERE level < ratio ORDER BY ratio, rank LIMIT 1) AS water FROM s5),
s7 AS (SELECT source, source_size, rank, least(source_size * {mixing.PASSES}.0e0, coalesce(weight * water, source_size * {mixing.PASSES}.0e0)) AS target, greatest(1, least({mixing.BLOCK}, source_size // {mixing.FEWEST})) AS block FROM s6),
s8 AS (SELECT *, CAST(ceil(source_size / block) AS BIGINT) AS blocks, CASE WHEN target > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {mixing.PASSES}) END AS whole FROM s7),
s9 AS (SELECT *, CASE WHEN target > 0 THEN greatest(1, least(whole * blocks + CAST(round((target - whole * source_size) / block) AS BIGINT), blocks * {mixing.PASSES})) ELSE 0 END AS want FROM s8),
s10 AS (SELECT *, sum(want) OVER () AS all_want, coalesce(sum(want) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM s9 WHERE want > 0),
n0 AS (SELECT rank, blocks, CAST(all_want AS BIGINT) AS all_want, CAST(low AS BIGINT) AS low, unnest(range(CAST(want AS BIGINT))) AS n FROM s10),
p0 AS (SELECT rank, blocks, all_want, (rank % {m}) * 1000003 + 1 + n // blocks AS seed, n % blocks AS x, low + n AS place FROM n0),
{', '.join(rounds)},
st AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id % {mixing.BUCKETS}, doc_id, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
cut AS (SELECT st.r, st.start, st.size, rank, block, unnest(range(CAST(st.start // block AS BIGINT), CAST((st.start + st.size - 1) // block + 1 AS BIGINT))) AS b FROM st JOIN s9 ON s9.source IS NOT DISTINCT FROM st.source WHERE st.size > 0),
part AS (SELECT cut.r, CAST(sum(least((b + 1) * block, start + size) - greatest(b * block, start)) AS BIGINT) AS words, count(DISTINCT place // {mixing.SLOTS_A_SHARD}) AS n_shards, min(place // {mixing.SLOTS_A_SHARD}) AS first_shard FROM cut JOIN {last} ON {last}.rank = cut.rank AND {last}.x = cut.b GROUP BY cut.r)
SELECT d.doc_id, d.size, s9.source_size, s9.target, coalesce(words, 0) AS taken, coalesce(n_shards, 0) AS n_shards, first_shard
FROM d JOIN s9 ON s9.source IS NOT DISTINCT FROM d.source LEFT JOIN part ON part.r = d.r
"""


def clustering(dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Every vector against every centroid, round by round."""
    steps, last = [], "c0"
    for r in range(rounds + 1):
        far = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i])))"
        steps.append(f"a{r} AS MATERIALIZED (SELECT r, CAST(min(p.cluster) AS INTEGER) AS cluster, CAST(min(p.far) AS BIGINT) AS distance FROM (SELECT e.r, c.cluster, {far} AS far, min({far}) OVER (PARTITION BY e.r) AS least FROM e, {last} c) p WHERE far = least GROUP BY r)")
        if r < rounds:
            exact = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            steps.append(f"m{r} AS (SELECT cluster, list(x ORDER BY i) AS v FROM (SELECT a{r}.cluster, i, {exact} AS x FROM (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) u JOIN a{r} USING (r) GROUP BY ALL) GROUP BY cluster)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM {last} c LEFT JOIN m{r} m USING (cluster))")
            last = f"c{r + 1}"
    return f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, v) - 1 AS cluster, v FROM (SELECT *, sha256('{seed}:' || vec_id) AS h FROM e WHERE vec_id IS NOT NULL ORDER BY h, vec_id, v LIMIT {k})),
{", ".join(steps)}
SELECT e.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM e JOIN a{rounds} a USING (r) JOIN {last} c ON c.cluster = a.cluster
"""


def importance(buckets: int = 10_000, percent: int = 5, fewest: int = 20, seed: int = 42) -> str:
    """Every distinct feature's CRC-32 byte by byte, then sums, sorting and a limit."""
    runs = lambda t: f"""
  SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM {t}"""  # noqa: E731
    words = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_UPPER, _LOWER)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, {words} AS w FROM benchmark),
fd AS MATERIALIZED ({runs("d")}),
fb AS MATERIALIZED ({runs("b")}),
tab AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v FROM range(256) x(n))),
f AS (SELECT DISTINCT f FROM (SELECT f FROM fd UNION ALL SELECT f FROM fb)),
h AS (SELECT f, hex(encode(f)) AS x FROM f),
crc AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)), lambda c, o: xor(t[(xor(c, o) & 255) + 1], c >> 8), 4294967295), 4294967295) % {buckets} AS k FROM h, tab),
s AS (SELECT k, count(*) AS n FROM fd JOIN crc USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM fb JOIN crc USING (f) GROUP BY k),
g AS (SELECT x.n AS k, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s AS s2) + {buckets}) / (CAST((coalesce(s.n, 0) + 1) AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets})))) AS BIGINT) AS gain FROM range({buckets}) x(n) LEFT JOIN s ON s.k = x.n LEFT JOIN t ON t.k = x.n),
w AS (SELECT r, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM fd JOIN crc USING (f) JOIN g USING (k) GROUP BY r),
z AS (
  SELECT d.r, doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{seed}:' || doc_id)[1:8] AS BIGINT) + 0.5e0) / 4294967296e0))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, {percent} * count(*) OVER () // 100 AS drawn FROM z WHERE n_words >= {fewest} AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM z LEFT JOIN ranked USING (r)
"""
