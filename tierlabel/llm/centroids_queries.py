from __future__ import annotations

from tierlabel.llm.centroids import centroid_clusters
from tierlabel.llm.common import table
from tierlabel.llm.registry import query

K, ROUNDS = 8, 10


def _sql() -> str:
    """Ten rounds written out: DuckDB has whole numbers of 128 bits, so all sums are exact."""

    def assigned(centroids: str) -> str:
        return f"""SELECT vec_id, row, v, c, d FROM (
            SELECT x.vec_id, x.row, x.v, m.c, list_sum(list_transform(list_zip(x.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d,
                   row_number() OVER (PARTITION BY x.row ORDER BY d, m.c) AS place FROM x CROSS JOIN {centroids} m) WHERE place = 1"""

    steps = [
        """x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v
             FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        f"""m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM
             (SELECT sha256('3:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT {K}))""",
    ]
    for i in range(ROUNDS):
        steps += [
            f"a{i} AS MATERIALIZED ({assigned(f'm{i}')})",
            f"s{i} AS (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS e, unnest(range(64)) AS i FROM a{i}) GROUP BY c, i)",
            f"""m{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(p.v, m.v) AS v FROM m{i} m LEFT JOIN
                (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{i} GROUP BY c) p ON p.c = m.c)""",
        ]
    return f"""WITH {", ".join(steps)}, f AS MATERIALIZED ({assigned(f'm{ROUNDS}')})
        SELECT vec_id, f.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
        FROM f JOIN m{ROUNDS} m ON m.c = f.c"""


@query("op13_centroid_clusters", _sql())
def op13(spark, folder):
    return centroid_clusters(table(spark, folder, "embeddings"), k=K, rounds=ROUNDS)[0]
