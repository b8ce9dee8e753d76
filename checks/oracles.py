"""For every query that SQL can express, the SQL that must give the same rows."""

from __future__ import annotations

PERSONS = """
persons AS (
  SELECT c_custkey + 1 AS id, c_name AS name, CAST(trunc(c_acctbal) AS INT) AS balance,
         n_name AS nation, r_name AS region, c_mktsegment AS segment,
         'Cluster ' || CAST(c_custkey // 5 + 1 AS VARCHAR) AS "Cluster"
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

DOMAIN = "dom AS (SELECT min(balance) AS lo, max(balance) AS hi FROM persons)"

# bounds of each cluster, its labels and its loss per row
PROFILE = """
prof AS (
  SELECT "Cluster", count(*) AS n, min(balance) AS lo, max(balance) AS hi,
         min(nation) AS n1, max(nation) AS n2, min(region) AS r1, max(region) AS r2,
         min(segment) AS s1, max(segment) AS s2
  FROM persons GROUP BY "Cluster"
)"""

N_LABEL = "CASE WHEN n1 = n2 THEN n1 WHEN r1 = r2 THEN r1 ELSE 'World' END"
N_ROOT = "CASE WHEN n1 = n2 THEN n1 ELSE 'World' END"
S_LABEL = "CASE WHEN s1 = s2 THEN s1 ELSE 'Any segment' END"
S_BARE = "CASE WHEN s1 = s2 THEN s1 ELSE '*' END"
B_LABEL = """CASE WHEN lo <> hi THEN '[' || CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) || ']'
             ELSE CAST(lo AS VARCHAR) END"""
LOSS = """((hi - lo) / CAST((SELECT hi - lo FROM dom) AS DOUBLE)
  + CASE WHEN n1 = n2 THEN 0.0 WHEN r1 = r2 THEN 0.5 ELSE 1.0 END
  + CASE WHEN s1 = s2 THEN 0.0 ELSE 1.0 END)"""
LOSS_REF = "(round(CAST((hi - lo) // n AS DOUBLE), 2) + 0.33 + 0.5)"

# distance of every person from the person with id 1
DISTANCE = """
one AS (SELECT * FROM persons WHERE id = 1),
dist AS (
  SELECT p.id, abs(p.balance - o.balance) / CAST(d.hi - d.lo AS DOUBLE) AS num,
         CAST(abs(p.balance - o.balance) // (d.hi - d.lo) AS DOUBLE) AS num_ref,
         CASE WHEN p.nation = o.nation THEN 0.0 WHEN p.region = o.region THEN 0.5 ELSE 1.0 END
         + CASE WHEN p.segment = o.segment THEN 0.0 ELSE 1.0 END AS cat,
         CASE WHEN p.nation = o.nation THEN 1.0 WHEN p.region = o.region THEN 0.67 ELSE 0.33 END
         + CASE WHEN p.segment = o.segment THEN 1.0 ELSE 0.5 END AS cat_ref
  FROM persons p, one o, dom d
)"""

# rise in loss when a person joins a cluster, for the pairs of one record or one cluster
UNION_LOSS = """((greatest(c.hi, p.balance) - least(c.lo, p.balance)) / CAST((SELECT hi - lo FROM dom) AS DOUBLE)
  + CASE WHEN c.n1 = c.n2 AND c.n1 = p.nation THEN 0.0 WHEN c.r1 = c.r2 AND c.r1 = p.region THEN 0.5 ELSE 1.0 END
  + CASE WHEN c.s1 = c.s2 AND c.s1 = p.segment THEN 0.0 ELSE 1.0 END)"""
DELTA = f"((c.n + 1) * {UNION_LOSS} - c.n * c.own)"

LINES = """
lines AS (
  SELECT CAST(l_quantity AS INT) AS quantity, n_name AS nation, r_name AS region,
         CAST(year(l_shipdate) AS VARCHAR) AS shipped, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

TOKENS = """
tokens AS (
  SELECT unnest(string_split(regexp_replace(text, ',+$', ''), ',')) AS token
  FROM documents WHERE text = '' OR regexp_replace(text, ',+$', '') <> ''
)"""

LABELLED = """
labelled AS (
  SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

PAIRS = """
pairs AS (
  SELECT sn.n_name AS seller, cn.n_name AS buyer, sr.r_name AS sr, cr.r_name AS cr, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  GROUP BY ALL
)"""


def report(before: str, after: str) -> str:
    return f"""{before} AS "before", {after} AS "after", {before} - {after} AS removed,
      round(({before} - {after}) / CAST({before} AS DOUBLE), 4) AS removed_share"""


def index_of(source: str, col: str, name: str) -> str:
    """A CTE that numbers labels by falling count, then by text."""
    return f"""{name} AS (
      SELECT v, CAST(row_number() OVER (ORDER BY c DESC, v) - 1 AS DOUBLE) AS i
      FROM (SELECT CAST({col} AS VARCHAR) AS v, count(*) AS c FROM {source} GROUP BY 1))"""


def naive_bayes(source: str, features: list[str], label: str, key: str = "id") -> str:
    """CTEs ``pred(id, label, prediction)``: multinomial naive Bayes with smoothing 1 on label indices."""
    names = [*features, label]
    ctes = [index_of(source, c, f"ix_{c}") for c in names]
    joins = " ".join(f"JOIN ix_{c} ON CAST(s.{c} AS VARCHAR) = ix_{c}.v" for c in names)
    values = ", ".join(f"ix_{c}.i AS f_{c}" for c in features)
    sums = ", ".join(f"sum(f_{c}) AS s_{c}" for c in features)
    whole = " + ".join(f"s_{c}" for c in features)
    m = len(features)
    score = " + ".join(f"e.f_{c} * ln((m.s_{c} + 1) / ({whole} + {m}))" for c in features)
    return ", ".join(
        [
            *ctes,
            f"enc AS (SELECT s.{key} AS id, ix_{label}.i AS y, {values} FROM {source} s {joins})",
            f"fit AS (SELECT y, count(*) AS c, {sums} FROM enc WHERE {trains('id')} GROUP BY y)",
            f"""scored AS (SELECT e.id, e.y AS label, m.y,
                  ln((m.c + 1) / CAST((SELECT sum(c) + count(*) FROM fit) AS DOUBLE)) + {score} AS score
                FROM enc e, fit m WHERE NOT {trains('e.id')})""",
            """pred AS (SELECT id, label, y AS prediction FROM (
                  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, y) AS r FROM scored) WHERE r = 1)""",
        ]
    )


def trains(key: str, training: float = 0.7, test: float = 0.3) -> str:
    """Whether a row trains: the first 32 bits of the MD5 of its key's text against the share."""
    cut = round(training / (training + test) * (1 << 32))
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) < {cut}"


ACCURACY = "(SELECT avg(CAST(label = prediction AS INT)) FROM {pred})"


def persons_with(*ctes: str) -> str:
    return "WITH " + ", ".join([PERSONS, DOMAIN, *ctes])



def greedy_counts(source: str, k: int = 5, block: int = 1000) -> str:
    """Rows and clusters the block rule gives; every other column states an invariant."""
    return f"""WITH t AS (SELECT count(*) AS n FROM {source}),
      b AS (SELECT n, greatest(1, n // {block}) AS nb FROM t),
      s AS (SELECT n, nb, n // nb AS base, n % nb AS rem FROM b)
      SELECT n AS "rows", rem * ((base + 1) // {k}) + (nb - rem) * (base // {k}) AS clusters,
             true AS min_ok, true AS max_ok, true AS centroids_ok, true AS members_ok FROM s"""


def hot(text: str, size: str) -> str:
    """A 0/1 list with a one at ``text`` as comma-separated text."""
    return f"array_to_string(list_transform(range(0, {size}), lambda x: CASE WHEN x = {text} THEN '1' ELSE '0' END), ',')"


PURCHASES = """
purchases AS (
  SELECT o_orderkey + 1 AS id, n_name AS nation, o_orderpriority AS priority, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

GENERALIZED = f"""
gen AS (
  SELECT p.id, {B_LABEL} AS balance, {N_LABEL} AS nation, p.segment
  FROM persons p JOIN prof USING ("Cluster")
)"""


def prefixed(ctes: str, prefix: str) -> str:
    """The naive Bayes CTEs under other names, so that two models fit in one statement."""
    out = ctes
    for name in ("ix_", "enc ", "enc\n", "fit ", "fit)", "scored", "pred "):
        out = out.replace(name, prefix + name)
    return out


def oracle_sql() -> dict[str, str]:
    normal = prefixed(naive_bayes("persons", ["balance", "nation"], "segment"), "a_")
    other = prefixed(naive_bayes("gen", ["balance", "nation"], "segment"), "b_")
    two_scores = f"{ACCURACY.format(pred='a_pred')} AS a, {ACCURACY.format(pred='b_pred')} AS b"
    out = {
        "csv_roundtrip": "SELECT * FROM customer",
        "csv_untyped": """SELECT n_name, c_mktsegment, count(*) AS n, CAST(max(c_nationkey) AS VARCHAR) AS key_text
            FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2""",
        "text_roundtrip": """SELECT CAST(o_custkey AS VARCHAR) || ',' || CAST(count(*) AS VARCHAR) AS value
            FROM orders GROUP BY o_custkey""",
        "config_attrs": """SELECT c_custkey, CAST(trunc(c_acctbal) AS INT) AS c_acctbal, c_mktsegment,
            CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer""",
        "preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 20",
        "model_roundtrip": "SELECT count(*) AS n, count(*) AS same FROM embeddings",
        "typed_projection": """SELECT c_custkey, CAST(trunc(c_acctbal) AS INT) AS c_acctbal,
            CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer""",
        "typed_text": """SELECT event_id, TRY_CAST(trunc(TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE)) AS INT) AS amount,
            TRY_CAST(event_type AS INT) AS event_type FROM events""",
        "role_projection": """SELECT c_custkey, CAST(trunc(c_acctbal) AS INT) AS c_acctbal, c_mktsegment,
            CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer""",
        "tag_rename_drop": "SELECT s_suppkey AS id, s_name, s_nationkey, 'Member' AS \"Info\" FROM supplier",
        "dense_id": "SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey, o_custkey FROM orders",
        "dense_id_copies": """SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_quantity) AS id,
            l_returnflag, l_linestatus, l_quantity FROM lineitem""",
        "dense_id_input_order": """SELECT count(*) AS ids, CAST(1 AS BIGINT) AS "first", count(*) AS "last",
            count(DISTINCT o_orderkey) AS orders FROM orders""",
        "row_cap": """SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey FROM orders)
            WHERE id <= 1000""",
        "key_lookup": "SELECT * FROM orders WHERE o_orderkey = 77",
        "cluster_rows": f'WITH {PERSONS} SELECT id, nation, "Cluster" FROM persons WHERE "Cluster" = \'Cluster 1\'',
        "ci_filter_topk": """SELECT p_brand, count(p_type) AS n FROM part WHERE lower(p_type) = 'economy'
            GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10""",
        "prefix_filter": f"""WITH {TOKENS} SELECT token, count(*) AS n FROM tokens
            WHERE starts_with(token, ' the') GROUP BY token""",
        "predictor_columns": f"WITH {PERSONS} SELECT nation, segment, 1 AS age FROM persons",
        "row_count": "SELECT count(*) AS n FROM lineitem",
        "token_count": f"WITH {TOKENS} SELECT token, count(*) AS n FROM tokens GROUP BY token",
        "token_stats": f"""WITH {TOKENS}, c AS (SELECT token, count(*) AS n FROM tokens GROUP BY token)
            SELECT count(*) AS tokens, (SELECT n FROM c ORDER BY n DESC, token DESC LIMIT 1) AS max_n,
            (SELECT token FROM c ORDER BY n DESC, token DESC LIMIT 1) AS max_token,
            CAST(sum(n) AS BIGINT) AS total FROM c""",
        "token_top3": f"""WITH {TOKENS} SELECT token, count(*) AS n FROM tokens GROUP BY token
            ORDER BY n, token LIMIT 3""",
        "describe_long": " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({c}) AS "count", {a} AS mean, {s} AS stddev,
                CAST(min({c}) AS VARCHAR) AS "min", CAST(max({c}) AS VARCHAR) AS "max" FROM customer"""
            for c, a, s in [
                (
                    c,
                    f"round(avg({c}), 4)" if number else "CAST(NULL AS DOUBLE)",
                    f"round(stddev_samp({c}), 4)" if number else "CAST(NULL AS DOUBLE)",
                )
                for c, number in [
                    ("c_custkey", True),
                    ("c_name", False),
                    ("c_nationkey", True),
                    ("c_acctbal", True),
                    ("c_mktsegment", False),
                ]
            ]
        ),
        "median_approx": "SELECT quantile_disc(o_totalprice, 0.5) AS median FROM orders",
        "mode_value": """SELECT o_custkey AS mode, count(*) AS n FROM orders GROUP BY 1
            ORDER BY n DESC, mode LIMIT 1""",
        "distinct_profile": " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 2"""
            for c in ("p_brand", "p_type", "p_size", "p_name")
        ),
        "distinct_values": "SELECT DISTINCT p_name FROM part",
        "minmax_all": "SELECT "
        + ", ".join(
            # adding 0 keeps a negative zero in the file's statistics out of the answer
            f"min({c} + 0) AS {c}_min, max({c} + 0) AS {c}_max"
            for c in (
                "l_orderkey",
                "l_partkey",
                "l_suppkey",
                "l_linenumber",
                "l_quantity",
                "l_extendedprice",
                "l_discount",
                "l_tax",
            )
        )
        + " FROM lineitem",
        "cluster_minmax": f"""WITH {PERSONS} SELECT "Cluster", min(balance) AS balance_min, max(balance) AS balance_max
            FROM persons GROUP BY 1""",
        "cluster_sizes": f'WITH {PERSONS} SELECT "Cluster", count(*) AS n FROM persons GROUP BY 1',
        "cluster_ndv": f"""WITH {PERSONS} SELECT "Cluster", count(DISTINCT balance) AS balance_ndv,
            count(DISTINCT nation) AS nation_ndv, count(DISTINCT segment) AS segment_ndv FROM persons GROUP BY 1""",
        "partition_census": "SELECT count(*) AS n, true AS ok FROM lineitem",
        "union_rows": "SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier",
        "except_rows": """SELECT c_custkey FROM customer
            EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""",
        "except_by_key": """SELECT * FROM customer
            WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
        "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
        "sorted_first_row": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1",
        "dedup_rows": """SELECT doc_id, lang, n_chars FROM documents
            WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)""",
        "dedup_report": f"SELECT {report('count(*)', 'count(DISTINCT text)')} FROM documents",
        "null_rows": f"WITH {LABELLED} SELECT * FROM labelled WHERE quality IS NOT NULL AND toxic IS NOT NULL",
        "null_report": f"""WITH {LABELLED} SELECT
            {report('count(*)', 'count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL)')} FROM labelled""",
        "null_token_report": f"""WITH {LABELLED} SELECT {report('count(*)', "count(*) FILTER (lang <> 'fr')")}
            FROM labelled""",
        "removal_share": f"""WITH {LABELLED}
            SELECT 'duplicates' AS reason, {report('count(*)', 'count(DISTINCT text)')} FROM documents UNION ALL
            SELECT 'nulls', {report('count(*)', 'count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL)')}
            FROM labelled""",
        "dgh_closure": """WITH RECURSIVE rows AS (
              SELECT 'World' AS value, CAST(NULL AS VARCHAR) AS parent, 1 AS level
              UNION ALL SELECT r_name, 'World', 2 FROM region
              UNION ALL SELECT n_name, r_name, 3 FROM nation JOIN region ON n_regionkey = r_regionkey
              UNION ALL SELECT s_name, n_name, 4 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
            walk AS (
              SELECT value, parent, level, 1 AS depth, value AS path FROM rows WHERE parent IS NULL
              UNION ALL SELECT r.value, r.parent, r.level, w.depth + 1, w.path || '/' || r.value
              FROM rows r JOIN walk w ON r.parent = w.value),
            below AS (
              SELECT a.value, max(b.depth) - a.depth AS height FROM walk a
              JOIN walk b ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY a.value, a.depth)
            SELECT walk.value, parent, level, depth, height, height = 0 AS is_leaf, path
            FROM walk JOIN below ON walk.value = below.value""",
        "dgh_height": """SELECT 'supplier' AS attr, CAST(3 + least(count(*), 1) - 1 AS INT) AS height,
            CAST(3 + least(count(*), 1) AS INT) AS levels FROM supplier""",
        "dgh_orphans": """SELECT 'doc ' || CAST(doc_id AS VARCHAR) AS value, 'orphan' AS issue FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "lca_pairs": f"""WITH {PAIRS} SELECT seller, buyer, n,
            CASE WHEN seller = buyer THEN seller WHEN sr = cr THEN sr ELSE 'World' END AS lca,
            CAST(CASE WHEN seller = buyer THEN 3 WHEN sr = cr THEN 2 ELSE 1 END AS INT) AS lca_level,
            CAST(CASE WHEN seller = buyer THEN 0 WHEN sr = cr THEN 1 ELSE 2 END AS INT) AS lca_height FROM pairs""",
        "ancestor_at_level": f"WITH {PERSONS} SELECT id, nation, region AS ancestor FROM persons",
        "num_distance": f"{persons_with(DISTANCE)} SELECT id, round(num, 4) AS distance FROM dist",
        "num_distance_ref": f"{persons_with(DISTANCE)} SELECT id, num_ref AS distance FROM dist",
        "cat_distance": f"""WITH {PAIRS} SELECT seller, buyer, n,
            CAST(CASE WHEN seller = buyer THEN 0 WHEN sr = cr THEN 0.5 ELSE 1 END AS DOUBLE) AS distance FROM pairs""",
        "cat_distance_ref": f"""WITH {PAIRS} SELECT seller, buyer, n,
            CAST(CASE WHEN seller = buyer THEN 1 WHEN sr = cr THEN 0.67 ELSE 0.33 END AS DOUBLE) AS distance
            FROM pairs""",
        "record_distance": f"{persons_with(DISTANCE)} SELECT id, round(num + cat, 4) AS distance FROM dist",
        "record_distance_ref": f"""{persons_with(DISTANCE)}
            SELECT id, round(num_ref + cat_ref, 4) AS distance FROM dist""",
        "furthest_record": f"""{persons_with(DISTANCE)} SELECT id, round(num + cat, 4) AS distance FROM dist
            ORDER BY round(num + cat, 9) DESC, id LIMIT 1""",
        "cluster_info_loss": f"""{persons_with(PROFILE)}
            SELECT "Cluster", n, round(n * {LOSS}, 4) AS info_loss FROM prof""",
        "cluster_info_loss_ref": f"""{persons_with(PROFILE)}
            SELECT "Cluster", n, round(n * {LOSS_REF}, 4) AS info_loss FROM prof""",
        "total_info_loss": f"""{persons_with(PROFILE)} SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS "rows",
            round(sum(n * {LOSS}), 4) AS info_loss FROM prof""",
        "delta_info_loss": f"""{persons_with(PROFILE, f"c AS (SELECT *, {LOSS} AS own FROM prof)")}
            SELECT p.id, round({DELTA}, 4) AS delta FROM persons p, c
            WHERE c."Cluster" = 'Cluster 1' AND p."Cluster" <> 'Cluster 1'""",
        "best_record": f"""{persons_with(PROFILE, f"c AS (SELECT *, {LOSS} AS own FROM prof)")}
            SELECT p.id, round({DELTA}, 4) AS delta FROM persons p, c
            WHERE c."Cluster" = 'Cluster 1' AND p."Cluster" <> 'Cluster 1'
            ORDER BY round({DELTA}, 9), p.id LIMIT 1""",
        "best_cluster": f"""{persons_with(PROFILE, f"c AS (SELECT *, {LOSS} AS own FROM prof)")}
            SELECT c."Cluster", round({DELTA}, 4) AS delta FROM persons p, c
            WHERE p.id = 1 AND c."Cluster" <> 'Cluster 1'
            ORDER BY round({DELTA}, 9), CAST(substr(c."Cluster", 9) AS BIGINT) LIMIT 1""",
        "leftover_assign": f"""{persons_with()}, f AS (SELECT count(*) // 7 * 7 AS full_rows FROM persons),
            prof AS (
              SELECT (id - 1) // 7 + 1 AS no, count(*) AS n, min(balance) AS lo, max(balance) AS hi,
                     min(nation) AS n1, max(nation) AS n2, min(region) AS r1, max(region) AS r2,
                     min(segment) AS s1, max(segment) AS s2
              FROM persons, f WHERE id <= full_rows GROUP BY 1),
            c AS (SELECT *, {LOSS} AS own FROM prof)
            SELECT id, 'Cluster ' || CAST(no AS VARCHAR) AS "Cluster" FROM (
              SELECT p.id, c.no, row_number() OVER (PARTITION BY p.id ORDER BY round({DELTA}, 9), c.no) AS r
              FROM persons p, c, f WHERE p.id > full_rows) WHERE r = 1""",
        "leftover_assign_many": f"""{persons_with()}, prof AS (
              SELECT (id - 1) // 5 + 1 AS no, count(*) AS n, min(balance) AS lo, max(balance) AS hi,
                     min(nation) AS n1, max(nation) AS n2, min(region) AS r1, max(region) AS r2,
                     min(segment) AS s1, max(segment) AS s2 FROM persons GROUP BY 1),
            c AS (SELECT *, {LOSS} AS own FROM prof),
            p AS (
              SELECT s_suppkey + 1 AS id, CAST(trunc(s_acctbal) AS INT) AS balance, n_name AS nation,
                     r_name AS region, 'BUILDING' AS segment
              FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
            SELECT id, 'Cluster ' || CAST(no AS VARCHAR) AS "Cluster" FROM (
              SELECT p.id, c.no, row_number() OVER (PARTITION BY p.id ORDER BY round({DELTA}, 9), c.no) AS r
              FROM p, c) WHERE r = 1""",
        "generalize_numeric": f"""{persons_with(PROFILE)} SELECT p.id, {B_LABEL} AS balance
            FROM persons p JOIN prof USING ("Cluster")""",
        "generalize_root": f"""{persons_with(PROFILE)} SELECT p.id, {N_ROOT} AS nation, {S_LABEL} AS segment
            FROM persons p JOIN prof USING ("Cluster")""",
        "generalize_lca": f"""{persons_with(PROFILE)} SELECT p.id, {N_LABEL} AS nation, {S_LABEL} AS segment
            FROM persons p JOIN prof USING ("Cluster")""",
        "generalize_level": f"""{persons_with(PROFILE)} SELECT p.id, {N_ROOT} AS nation, {S_LABEL} AS segment
            FROM persons p JOIN prof USING ("Cluster")""",
        "k_anonymize": f"""{persons_with(PROFILE)} SELECT p.id, p.name, {B_LABEL} AS balance,
            {N_LABEL} AS nation, {S_BARE} AS segment FROM persons p JOIN prof USING ("Cluster")""",
        "k_anonymize_bounded": f"""{persons_with(PROFILE)} SELECT p.id, p.name, {B_LABEL} AS balance,
            {N_LABEL} AS nation, {S_LABEL} AS segment FROM persons p JOIN prof USING ("Cluster")""",
        "k_anonymize_hot": f"""WITH {LINES}, prof AS (
              SELECT flag, status, count(*) AS n, min(quantity) AS lo, max(quantity) AS hi,
                     min(nation) AS n1, max(nation) AS n2, min(region) AS r1, max(region) AS r2,
                     min(shipped) AS s1, max(shipped) AS s2 FROM lines GROUP BY flag, status)
            SELECT flag, status, {B_LABEL} AS quantity, {N_LABEL} AS nation, {S_BARE} AS shipped, n FROM prof""",
        "verify_k": f"""{persons_with(PROFILE)}, classes AS (
              SELECT {B_LABEL} AS b, {N_LABEL} AS na, {S_LABEL} AS s, count(*) AS n
              FROM persons p JOIN prof USING ("Cluster") GROUP BY 1, 2, 3)
            SELECT count(*) AS classes, CAST(sum(n) AS BIGINT) AS "rows", min(n) AS min_class_size FROM classes""",
        "coverage": f"""{persons_with(PROFILE)}, c AS (
              SELECT CASE WHEN lo <> hi OR n1 <> n2 OR s1 <> s2 THEN 1 ELSE 0 END AS c
              FROM persons p JOIN prof USING ("Cluster"))
            SELECT count(*) AS "rows", CAST(sum(c) AS BIGINT) AS anonymized,
                   CAST(sum(1 - c) AS BIGINT) AS not_anonymized, CAST(0 AS BIGINT) AS removed,
                   round(avg(c), 4) AS anonymized_share, round(1 - avg(c), 4) AS not_anonymized_share FROM c""",
        "coverage_removed": f"""{persons_with(PROFILE)}, c AS (
              SELECT CASE WHEN p.segment = 'BUILDING' THEN NULL
                          WHEN lo <> hi OR n1 <> n2 OR s1 <> s2 THEN 1 ELSE 0 END AS c
              FROM persons p JOIN prof USING ("Cluster"))
            SELECT count(*) AS "rows", CAST(sum(c) AS BIGINT) AS anonymized,
                   CAST(coalesce(sum(1 - c), 0) AS BIGINT) AS not_anonymized, count(*) - count(c) AS removed,
                   round(sum(c) / count(*), 4) AS anonymized_share,
                   round(sum(1 - c) / count(*), 4) AS not_anonymized_share FROM c""",
        "sample_one": "SELECT CAST(1 AS BIGINT) AS n, true AS in_table, true AS same_again FROM customer LIMIT 1",
        "greedy_sizes": greedy_counts("customer"),
        "greedy_lineitem": greedy_counts("lineitem"),
        "greedy_loss": "SELECT count(*) AS n, true AS below_hashed, true AS below_z_order FROM customer",
        "greedy_keeps_rows": f"WITH {PERSONS} SELECT id, name, balance, nation, segment FROM persons",
        "anonymize_job": 'SELECT count(*) AS "rows", true AS k_ok, count(*) AS sensitive_kept FROM orders',
        "string_index": f"""WITH {PERSONS}, {index_of('persons', 'nation', 'a')}, {index_of('persons', 'segment', 'b')}
            SELECT id, nation, segment, a.i AS "nation_Index", b.i AS "segment_Index"
            FROM persons JOIN a ON nation = a.v JOIN b ON segment = b.v""",
        "string_index_wide": f"""WITH {index_of('orders', 'o_custkey', 'a')}
            SELECT o_orderkey, o_custkey, a.i AS "o_custkey_Index"
            FROM orders JOIN a ON CAST(o_custkey AS VARCHAR) = a.v""",
        "one_hot": f"""WITH {PERSONS}, {index_of('persons', 'segment', 'b')}
            SELECT id, {hot('b.i', '(SELECT count(*) + 1 FROM b)')} AS hot FROM persons JOIN b ON segment = b.v""",
        "feature_index": f"""WITH {PERSONS}, {index_of('persons', 'nation', 'a')}, {index_of('persons', 'segment', 'b')}
            SELECT id, CAST(CAST(a.i AS INT) AS VARCHAR) || ',' || CAST(CAST(b.i AS INT) AS VARCHAR) AS f
            FROM persons JOIN a ON nation = a.v JOIN b ON segment = b.v""",
        "feature_onehot": f"""WITH {PERSONS}, {index_of('persons', 'nation', 'a')}, {index_of('persons', 'segment', 'b')}
            SELECT id, {hot('a.i', '(SELECT count(*) + 1 FROM a)')} || ',' ||
                   {hot('b.i', '(SELECT count(*) + 1 FROM b)')} AS f
            FROM persons JOIN a ON nation = a.v JOIN b ON segment = b.v""",
        "kmeans_invariants": "SELECT count(*) AS n, true AS low_ok, true AS high_ok, true AS score_ok FROM embeddings",
        "silhouette_fixed": """WITH v AS (
              SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i,
                     CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
            q AS (SELECT vec_id, label, sum(x * x) AS xx FROM v GROUP BY 1, 2),
            m AS (SELECT label, i, sum(x) AS y FROM v GROUP BY 1, 2),
            s AS (SELECT label, sum(xx) AS psi, count(*) AS n FROM q GROUP BY 1),
            dots AS (SELECT v.vec_id, m.label AS other, sum(v.x * m.y) AS xy FROM v JOIN m ON v.i = m.i GROUP BY 1, 2),
            d AS (
              SELECT q.vec_id, q.label, dots.other, s.n * q.xx + s.psi - 2 * dots.xy AS total, s.n
              FROM q JOIN dots ON q.vec_id = dots.vec_id JOIN s ON s.label = dots.other),
            ab AS (
              SELECT vec_id, max(CASE WHEN label = other THEN total / greatest(n - 1, 1) END) AS a,
                     min(CASE WHEN label <> other THEN total / n END) AS b,
                     max(CASE WHEN label = other THEN n END) AS own FROM d GROUP BY vec_id)
            SELECT count(*) AS n, round(avg(CASE WHEN own = 1 OR a = b THEN 0.0
              WHEN a < b THEN 1 - a / b ELSE b / a - 1 END), 4) AS score FROM ab""",
        "hash_split": " UNION ALL ".join(
            f"""SELECT o_orderkey, '{a}:{b}' AS weights,
                CASE WHEN {trains('o_orderkey', a, b)} THEN 'training' ELSE 'test' END AS part FROM orders"""
            for a, b in ((0.7, 0.3), (0.6, 0.2), (0.75, 0.25), (7.0, 1.0))
        ),
        "nb_predict": f"""WITH {PURCHASES}, {naive_bayes('purchases', ['nation', 'priority'], 'status')}
            SELECT id, prediction FROM pred""",
        "nb_accuracy": f"""WITH {PURCHASES}, {naive_bayes('purchases', ['nation', 'priority'], 'status')}
            SELECT count(*) AS n, round(avg(CAST(label = prediction AS INT)), 4) AS accuracy FROM pred""",
        "utility_compare": f"""{persons_with(PROFILE, GENERALIZED)}, {normal}, {other},
            s AS (SELECT {two_scores})
            SELECT 'Normal table' AS "Info", 'accuracy' AS metric, round(a, 4) AS score FROM s UNION ALL
            SELECT 'Anonymize table', 'accuracy', round(b, 4) FROM s UNION ALL
            SELECT 'Difference', 'accuracy', round(abs(a - b), 4) FROM s""",
        "examine_job": " UNION ALL ".join(
            f"SELECT '{i}' AS \"Info\", 'silhouette' AS metric, true AS ok, count(*) AS n FROM customer"
            for i in ("Normal table", "Anonymize table", "Difference")
        ),
        "examine_single": f"""{persons_with()}, {naive_bayes('persons', ['balance', 'nation'], 'segment')}
            SELECT 'Normal table' AS "Info", 'accuracy' AS metric,
                   round(avg(CAST(label = prediction AS INT)), 4) AS score FROM pred""",
        "examine_predictions": f"WITH {PERSONS} SELECT id, balance, nation, segment FROM persons WHERE NOT {trains('id')}",
    }
    out["examine_job_file"] = out["utility_compare"]
    return out | job_files()


def job_files() -> dict[str, str]:
    """What the jobs write when they are run from their files."""
    tree = "\nUNION ALL ".join(
        f"""SELECT 'nation' AS attr, 'World' AS "value", 'World' AS parent, 1 AS level, '{x}' AS layout
            UNION ALL SELECT 'nation', r_name, 'World', 2, '{x}' FROM region
            UNION ALL SELECT 'nation', n_name, r_name, 3, '{x}' FROM nation JOIN region ON n_regionkey = r_regionkey"""
        for x in ("flat", "nested")
    )
    names = "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split()
    columns = " UNION ALL ".join(
        f"SELECT {i} AS place, '{n}' AS name, count({n}) AS filled FROM customer" for i, n in enumerate(names)
    )
    anonymized = " UNION ALL ".join(
        f"""SELECT '{layout}' AS layout, n AS "rows", true AS k_ok, n AS labels_right, n AS sensitive_kept
            FROM (SELECT {rows} AS n FROM customer)"""
        for layout, rows in (("nested", "count(*)"), ("flat", "least(count(*), 500)"))
    )
    return {
        "dgh_layouts": tree,
        "sorted_by_key": f"WITH {PERSONS} SELECT row_number() OVER (ORDER BY id) AS place, id, name FROM persons",
        "column_names": columns,
        "explore_job_file": """SELECT DISTINCT 'c_mktsegment' AS "column", c_mktsegment AS "value" FROM customer
            UNION ALL SELECT DISTINCT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer""",
        "anonymize_job_file": anonymized,
    }
