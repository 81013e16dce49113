"""SQL for the queries that SQL can express on whole tables."""

from .ids import EMPTY_SHA256

_SPLIT = "CASE WHEN lower(trim(split, chr(9) || chr(10) || ' ')) IN ('train', 'training') THEN 'train' WHEN lower(trim(split, chr(9) || chr(10) || ' ')) IN ('val', 'valid', 'validation') THEN 'val' WHEN lower(trim(split, chr(9) || chr(10) || ' ')) IN ('dev', 'development', 'test') THEN 'dev' END"
_COMPONENT = r"nullif(regexp_extract(lower(trim(near_duplicate_component_id, chr(9) || chr(10) || chr(13) || ' ')), '(?:^|[^0-9a-z])([0-9a-f]{24}|ip[0-9]{9})$', 1), '')"
_DIGEST = r"CASE WHEN regexp_matches(d, '^sha-?256[-:=][A-Za-z0-9+/]{43}=$', 'i') THEN lower(hex(from_base64(regexp_extract(d, '[-:=]([A-Za-z0-9+/]{43}=)$', 1)))) ELSE nullif(regexp_extract(lower(d), '^(?:sha-?256[-:=])?([0-9a-f]{8,64})(?:…|\\.\\.\\.)?$', 1), '') END"

_ROWS = f"""w AS (SELECT *, nullif(regexp_extract(upper(source_image_id), '(?:^|[^0-9A-Z])(IP[0-9]{{9}})(?:[^0-9]|$)', 1), '') AS image FROM provenance),
x AS (SELECT id, coalesce(family_id, CASE WHEN image IS NOT NULL THEN max(family_id) OVER (PARTITION BY image) END) AS family_id, {_SPLIT} AS split, {_COMPONENT} AS c, trim(source_image_sha256, chr(9) || chr(10) || chr(13) || ' ') AS d FROM w),
y AS (SELECT id, family_id, split, c, {_DIGEST} AS d FROM x),
z AS (SELECT id, family_id, split, c, CASE WHEN NOT starts_with('{EMPTY_SHA256}', d) AND replace(d, d[1], '') <> '' THEN d END AS d FROM y)"""

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH {_ROWS}, t AS (SELECT DISTINCT d FROM z WHERE split = 'train' AND d IS NOT NULL), e AS (SELECT DISTINCT d FROM z WHERE split IN ('val', 'dev') AND d IS NOT NULL),
n AS (SELECT DISTINCT length(d) AS n FROM z WHERE d IS NOT NULL AND length(d) < 64),
m AS (SELECT d FROM e WHERE d IN (SELECT d FROM t) UNION SELECT e.d FROM e JOIN n ON length(e.d) = n.n JOIN t ON substr(t.d, 1, n.n) = e.d UNION SELECT e.d FROM e JOIN n ON length(e.d) > n.n JOIN t ON length(t.d) = n.n AND substr(e.d, 1, n.n) = t.d),
k AS (SELECT DISTINCT c FROM z WHERE split = 'train' AND c IS NOT NULL)
SELECT id, CASE WHEN bool_or(m.d IS NOT NULL) THEN 'exact' ELSE 'near' END AS overlap FROM z LEFT JOIN m ON m.d = z.d LEFT JOIN k ON k.c = z.c WHERE z.split IN ('val', 'dev') AND (m.d IS NOT NULL OR k.c IS NOT NULL) GROUP BY id""",
    "p2_found": f"""WITH {_ROWS} SELECT 'family' AS key_kind, family_id AS key_id FROM z WHERE split IN ('train', 'val', 'dev') AND family_id IS NOT NULL GROUP BY family_id HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'component', c FROM z WHERE split IN ('train', 'val', 'dev') AND length(c) = 24 GROUP BY c HAVING count(DISTINCT split) > 1""",
    "p6_found": """WITH r AS (SELECT lower(trim(id)) AS i, min(class_id) AS class_id, min(nullif(lower(trim(probe_split)), '')) AS probe_split FROM feature_rows GROUP BY 1), k AS (SELECT * FROM r WHERE class_id IS NOT NULL AND probe_split IS NOT NULL), c AS (SELECT class_id, probe_split, count(*) AS n FROM k GROUP BY ALL)
SELECT t.class_id, t.probe_split FROM sample_targets t LEFT JOIN c USING (class_id, probe_split) WHERE coalesce(c.n, 0) < greatest(t.min_rows, t.target_share * (SELECT count(*) FROM k) / 10)""",
}
