"""The general problems in ANSI SQL, as an independent check (other expressions, ranking in place of aggregation)."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import cache
from zoneinfo import ZoneInfo

from gridsmith.functions.timestamps import ABBREVIATIONS, MONTHS

# The clocks of the producers.
ZONES = ["Africa/Nairobi", "America/Denver", "Asia/Kolkata", "Australia/Sydney", "Europe/Berlin", "Pacific/Auckland", "UTC"]


@cache
def clock_rows(first: int = 2000, last: int = 2040) -> str:
    """VALUES rows (zone, local microseconds from which an offset holds, offset in minutes)."""
    rows = []
    for name in ZONES:
        zone = ZoneInfo(name)
        at = datetime(first, 1, 1, tzinfo=UTC)
        before = zone.utcoffset(at)
        rows.append((name, -(2**62), before))
        while at.year < last:
            nxt = at + timedelta(days=7)
            after = zone.utcoffset(nxt.astimezone(zone))
            if zone.utcoffset(at.astimezone(zone)) != after:
                lo, hi = at, nxt
                while hi - lo > timedelta(seconds=1):
                    mid = lo + (hi - lo) / 2
                    lo, hi = (mid, hi) if mid.astimezone(zone).utcoffset() == at.astimezone(zone).utcoffset() else (lo, mid)
                change = int(hi.timestamp() + 0.5)
                # A local time that occurs twice still has the old offset, and so has a skipped one.
                old = at.astimezone(zone).utcoffset()
                rows.append((name, int((change + max(old, after).total_seconds()) * 1_000_000), after))
            at = nxt
    return ", ".join(f"('{z}', {t}, {int(o.total_seconds() // 60)})" for z, t, o in rows)


def instants(source: str) -> str:
    """CTEs ending in ``read`` (the columns of ``source`` and ``utc``); ``source`` gives row_key, text, product."""
    names = ["num", "y1", "m1", "d1", "y2", "j2", "y3", "m3", "d3", "a4", "b4", "y4", "d5", "m5", "y5", "d6", "m6", "y6", "hh", "mi", "ss", "ff", "ap", "sg", "oh", "om", "iz", "ab"]
    mon = "|".join(MONTHS)
    pattern = (
        r"(?i)^(?:(\d{9,20})|(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})-(\d{3})|(\d{4})(\d{2})(\d{2})|(\d{1,2})/(\d{1,2})/(\d{4})"
        rf"|(\d{{1,2}})-({mon})-(\d{{4}})|(?:[a-z]{{3}},? )?(\d{{1,2}}) ({mon}) (\d{{4}}))(?:t| +)"
        r"(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?(?: ?([ap]m))?(?: ?(?:([+-])(\d{2})(?::?(\d{2}))?|\[([a-z][a-z_/+0-9-]*)\]|([a-z]{1,5})))?)$"
    )
    listed = ", ".join(f"'{n}'" for n in names)
    months = ", ".join(f"'{m}'" for m in MONTHS)
    abbr = " ".join(f"WHEN '{a}' THEN {m}" for a, m in ABBREVIATIONS.items())
    return f"""
    source AS ({source}),
    clock AS (SELECT product_name AS product, time_zone, date_order FROM product JOIN producer USING (producer_name)),
    zones(zone, since, minutes) AS (VALUES {clock_rows()}),
    cut AS (
        SELECT s.*, c.time_zone, c.date_order, regexp_extract(regexp_replace(s.text, '^\\s+|\\s+$', '', 'g'), '{pattern}', [{listed}]) AS x
        FROM source s LEFT JOIN clock c USING (product)
    ),
    fields AS (
        SELECT *, try_cast(x.y1 || x.y2 || x.y3 || x.y4 || x.y5 || x.y6 AS int) AS yy,
            CASE WHEN x.y4 <> '' THEN try_cast(CASE date_order WHEN 'dmy' THEN x.b4 WHEN 'mdy' THEN x.a4 END AS int)
                 WHEN x.m5 || x.m6 <> '' THEN list_position([{months}], lower(x.m5 || x.m6)) ELSE try_cast(x.m1 || x.m3 AS int) END AS mm,
            CASE WHEN x.y4 <> '' THEN try_cast(CASE date_order WHEN 'dmy' THEN x.a4 WHEN 'mdy' THEN x.b4 END AS int) ELSE try_cast(x.d1 || x.d3 || x.d5 || x.d6 AS int) END AS dd,
            CASE WHEN x.ap = '' THEN try_cast(x.hh AS int) WHEN try_cast(x.hh AS int) BETWEEN 1 AND 12
                 THEN try_cast(x.hh AS int) % 12 + CASE lower(x.ap) WHEN 'pm' THEN 12 ELSE 0 END END AS h
        FROM cut
    ),
    days AS (
        SELECT *, CASE WHEN x.j2 = '' THEN try_cast(printf('%04d-%02d-%02d', yy, mm, dd) AS date)
                  WHEN year(make_date(CASE WHEN x.j2 <> '' AND yy > 0 THEN yy END, 1, 1) + (try_cast(x.j2 AS int) - 1)) = yy AND try_cast(x.j2 AS int) > 0 THEN make_date(CASE WHEN x.j2 <> '' AND yy > 0 THEN yy END, 1, 1) + (try_cast(x.j2 AS int) - 1) END AS day
        FROM fields
    ),
    walls AS (
        SELECT *, CASE WHEN yy >= 1 AND h <= 23 AND try_cast(x.mi AS int) <= 59 AND coalesce(try_cast(nullif(x.ss, '') AS int), 0) <= 59
            THEN (((date_diff('day', DATE '1970-01-01', day) * 24 + h) * 60 + try_cast(x.mi AS int)) * 60 + coalesce(try_cast(nullif(x.ss, '') AS int), 0)) * 1000000
                 + try_cast(substr(rpad(x.ff, 6, '0'), 1, 6) AS bigint) END AS wall,
            CASE WHEN x.sg <> '' THEN (try_cast(x.oh AS int) * 60 + coalesce(try_cast(nullif(x.om, '') AS int), 0)) * CASE x.sg WHEN '-' THEN -1 ELSE 1 END
                 WHEN x.ab <> '' THEN CASE upper(x.ab) {abbr} END END AS named,
            CASE WHEN x.iz <> '' THEN x.iz WHEN x.ab = '' AND x.sg = '' THEN time_zone END AS zone
        FROM days
    ),
    read AS (
        SELECT w.* EXCLUDE (zone, x), CAST(CASE
            WHEN x.num <> '' THEN CASE WHEN length(x.num) <= 11 THEN try_cast(x.num AS hugeint) * 1000000 WHEN length(x.num) <= 14 THEN try_cast(x.num AS hugeint) * 1000
                 WHEN length(x.num) <= 17 THEN try_cast(x.num AS hugeint) ELSE try_cast(x.num AS hugeint) // 1000 END
            WHEN named IS NOT NULL THEN wall - named * CAST(60000000 AS bigint)
            ELSE wall - z.minutes * CAST(60000000 AS bigint) END AS bigint) AS utc
        FROM walls w ASOF LEFT JOIN zones z ON w.zone = z.zone AND w.wall >= z.since
    )"""


_CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z$"
_SENT = instants("SELECT delivery_id AS row_key, sent_timestamp AS text, product, message_id, message, message_attributes FROM sqs_message")
_KEYED = f"""WITH {_SENT},
keyed AS (
    SELECT *, row_key AS delivery_id, nullif(regexp_replace(regexp_replace(lower(message_id), '^\\s*urn:uuid:', ''), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '') AS k FROM read
),
ranked AS (SELECT *, CASE WHEN k IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY k ORDER BY utc NULLS LAST, delivery_id) END AS place FROM keyed)"""

_DATASETS = r"""WITH parsed AS (SELECT doc_no, href, try_cast(ltrim(doc, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS json) AS j FROM odc_document),
datasets AS (
    SELECT doc_no, href, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN j->'$[*]' WHEN json_type(j->'datasets') = 'ARRAY' THEN j->'$.datasets[*]' ELSE [j] END) AS ds FROM parsed WHERE j IS NOT NULL
),
numbered AS (SELECT *, row_number() OVER () AS n FROM datasets WHERE json_type(ds) = 'OBJECT')"""

_COLUMN_TYPES = [("boolean", "boolean"), ("bigint", "bigint"), ("double", "double"), ("string", "varchar"), ("json", "varchar")]
# The columns come from the data, as in the operator: the prevailing kind of each core name decides.
_CELLS = r"""lines AS (SELECT min(line_key) AS line_key, file_no, try_cast(payload AS json) AS j FROM metadata_line GROUP BY file_no, line_no, payload),
        listed AS (SELECT line_key, j, unnest(json_keys(j)) AS field, generate_subscripts(json_keys(j), 1) AS nth FROM (SELECT line_key, try_cast(payload AS json) AS j FROM metadata_line) WHERE json_type(j) = 'OBJECT'),
        cells AS (
            SELECT line_key, field, nth, replace(regexp_replace(regexp_replace(lower(regexp_replace(field, '^.*:', '')), '^eo_|_m$', '', 'g'), 'name$', ''), '_', '') AS core,
                json_type(j, '$."' || field || '"') AS t, json_extract(j, '$."' || field || '"') AS raw, json_extract_string(j, '$."' || field || '"') AS text
            FROM listed WHERE json_type(j, '$."' || field || '"') <> 'NULL'
        ),
        counted AS (
            SELECT core, count(*) FILTER (t = 'BOOLEAN') AS booleans, count(*) FILTER (t IN ('ARRAY', 'OBJECT')) AS parts, count(*) FILTER (t IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS numbers,
                count(*) FILTER (t = 'DOUBLE') AS points, count(*) FILTER (t = 'VARCHAR') AS texts
            FROM cells GROUP BY core
        ),
        types AS (
            SELECT core, CASE greatest(booleans, parts, numbers, texts) WHEN booleans THEN 'boolean' WHEN parts THEN 'json' WHEN numbers THEN CASE WHEN points > 0 THEN 'double' ELSE 'bigint' END ELSE 'string' END AS dtype
            FROM counted
        ),
        valued AS (
            SELECT c.*, dtype, row_number() OVER (PARTITION BY line_key, core ORDER BY nth) AS spelling,
                CASE WHEN dtype = 'json' THEN CAST(raw AS varchar) WHEN t = 'ARRAY' THEN json_extract_string(raw, '$[0]') WHEN t = 'OBJECT' THEN json_extract_string(raw, '$.name') ELSE text END AS v
            FROM cells c JOIN types USING (core)
        )"""

ORACLES = {
    "p1_found": f"""{_KEYED},
        events AS (
            SELECT lower(trim(try_cast(message AS json)->>'$.id')) AS dataset_id, utc, delivery_id, upper(trim(coalesce(message_attributes['action'].attr_value, ''))) AS action
            FROM ranked WHERE place = 1
        ),
        last AS (
            SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY utc DESC, delivery_id DESC) AS place FROM events
            WHERE dataset_id <> '' AND utc IS NOT NULL AND action IN ('', 'ADDED', 'UPDATED', 'ARCHIVED')
        )
        SELECT dataset_id, delivery_id FROM last WHERE place = 1 AND action <> 'ARCHIVED'""",
    "p3_found": rf"""{_DATASETS},
        measurements AS (
            SELECT doc_no, href, ds, unnest(json_keys(ds->'measurements')) AS band, NULL AS item FROM numbered WHERE json_type(ds->'measurements') = 'OBJECT'
            UNION ALL SELECT doc_no, href, ds, NULL, unnest(ds->'$.measurements[*]') FROM numbered WHERE json_type(ds->'measurements') = 'ARRAY'
        ),
        named AS (
            SELECT doc_no, href, ds, coalesce(band, item->>'name') AS band, coalesce(item, json_extract(ds, '$.measurements."' || band || '"')) AS m FROM measurements
        ),
        placed AS (
            SELECT *, coalesce(nullif(m->>'grid', ''), 'default') AS grid_name, m->>'path' AS path FROM named
        ),
        gridded AS (
            SELECT *, json_extract(ds, '$.grids."' || grid_name || '"') AS g FROM placed WHERE path <> ''
        ),
        flat AS (
            SELECT *, CASE WHEN json_type(g, '$.transform[0]') = 'ARRAY' THEN [g->>'$.transform[0][2]', g->>'$.transform[1][2]'] ELSE [g->>'$.transform[2]', g->>'$.transform[5]'] END AS xy,
                CASE WHEN regexp_matches(path, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN path ELSE regexp_replace(href, '[^/]*$', '') || path END AS joined
            FROM gridded WHERE g IS NOT NULL
        )
        SELECT doc_no, ds->>'id' AS dataset_id, band, grid_name, CAST(CAST(g->>'$.shape[0]' AS double) AS bigint) AS n_rows, CAST(CAST(g->>'$.shape[1]' AS double) AS bigint) AS n_cols,
            CAST(CAST(xy[1] AS double) AS bigint) AS x0, CAST(CAST(xy[2] AS double) AS bigint) AS y0,
            regexp_replace(replace(joined, '/./', '/'), '/[^/]+/\.\./', '/', 'g') AS asset_href
        FROM flat""",
    "p3_lineage": rf"""{_DATASETS},
        labels AS (SELECT doc_no, ds, unnest(json_keys(ds->'lineage')) AS label FROM numbered WHERE json_type(ds->'lineage') = 'OBJECT')
        SELECT doc_no, ds->>'id' AS dataset_id, label, unnest(json_extract(ds, '$.lineage."' || label || '"')->>'$[*]') AS parent_id FROM labels""",
    "p3_properties": rf"""{_DATASETS},
        named AS (SELECT doc_no, ds, unnest(json_keys(ds->'properties')) AS name FROM numbered WHERE json_type(ds->'properties') = 'OBJECT')
        SELECT doc_no, ds->>'id' AS dataset_id, name, CAST(json_extract(ds, '$.properties."' || name || '"') AS varchar) AS value FROM named""",
    "p3_tables": rf"""{_DATASETS},
        parts AS (SELECT n, ds, part, json_extract(ds, '$.' || part) AS p FROM numbered, (VALUES ('grids'), ('measurements'), ('accessories'), ('lineage'), ('properties'), ('geometry')) v(part)),
        keyed AS (SELECT n, part, unnest(json_keys(p)) AS k, p FROM parts WHERE json_type(p) = 'OBJECT'),
        elements AS (
            SELECT part, json_extract(p, '$."' || k || '"') AS x FROM keyed UNION ALL SELECT part, unnest(p->'$[*]') FROM parts WHERE json_type(p) = 'ARRAY'
        ),
        listed AS (SELECT unnest(json_keys(ds)) AS k, ds FROM numbered),
        counts AS (
            SELECT 'dataset' AS kind, count(*) AS n FROM numbered WHERE json_keys(ds) <> []
            UNION ALL SELECT CASE part WHEN 'grids' THEN 'grid' WHEN 'measurements' THEN 'measurement' ELSE 'accessory' END, count(*) FROM elements WHERE part IN ('grids', 'measurements', 'accessories') AND json_type(x) = 'OBJECT' GROUP BY part
            UNION ALL SELECT 'lineage', CAST(sum(CASE json_type(x) WHEN 'ARRAY' THEN json_array_length(x) ELSE 1 END) AS bigint) FROM elements WHERE part = 'lineage' AND json_type(x) IN ('ARRAY', 'VARCHAR')
            UNION ALL SELECT 'property', count(*) FROM elements WHERE part = 'properties'
            UNION ALL SELECT 'geometry', count(*) FROM parts WHERE part = 'geometry' AND json_type(p) = 'OBJECT'
            UNION ALL SELECT 'other', count(*) FROM listed WHERE k NOT IN ('id', 'label', 'crs', 'product')
                AND json_type(ds, '$."' || k || '"') NOT IN ('OBJECT', 'ARRAY')
        )
        SELECT kind, true AS inside, n FROM counts WHERE n > 0""",
    "p4_found": r"""WITH lines AS (SELECT stream_no, file_no, written_at, try_cast(payload AS json) AS j FROM metadata_line),
        cells AS (SELECT stream_no, file_no, written_at, j, unnest(json_keys(j)) AS field FROM lines WHERE json_type(j) = 'OBJECT'),
        kinds AS (
            SELECT stream_no, file_no, written_at, field, max(CASE json_type(j, '$."' || field || '"') WHEN 'VARCHAR' THEN 'text' WHEN 'UBIGINT' THEN 'whole' WHEN 'BIGINT' THEN 'whole'
                WHEN 'DOUBLE' THEN 'point' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' END) AS kind
            FROM cells GROUP BY ALL
        ),
        files AS (SELECT stream_no, file_no, lag(file_no) OVER (PARTITION BY stream_no ORDER BY written_at, file_no) AS before FROM (SELECT DISTINCT stream_no, file_no, written_at FROM lines)),
        pairs AS (
            SELECT f.file_no, o.field AS old_field, o.kind AS old_kind, n.field AS new_field, n.kind AS new_kind
            FROM files f JOIN kinds o ON o.file_no = f.before LEFT JOIN kinds n ON n.file_no = f.file_no AND n.field = o.field
            UNION ALL
            SELECT f.file_no, NULL, NULL, n.field, n.kind FROM files f JOIN kinds n ON n.file_no = f.file_no AND f.before IS NOT NULL
            WHERE NOT EXISTS (SELECT 1 FROM kinds o WHERE o.file_no = f.before AND o.field = n.field)
        ),
        cores AS (
            SELECT *, regexp_replace(replace(regexp_replace(lower(regexp_replace(coalesce(old_field, new_field), '^.*:', '')), '^eo_|_m$', '', 'g'), '_', ''), 'name$', '') AS core FROM pairs
        ),
        renamed AS (
            SELECT a.file_no, a.old_field, a.old_kind, b.new_field, b.new_kind FROM cores a JOIN cores b ON a.file_no = b.file_no AND a.core = b.core
            WHERE a.new_field IS NULL AND b.old_field IS NULL
        )
        SELECT file_no, 'renamed' AS change_kind, old_field, new_field FROM renamed
        UNION ALL SELECT file_no, 'retyped', old_field, new_field FROM renamed WHERE old_kind <> new_kind
        UNION ALL SELECT file_no, 'retyped', old_field, new_field FROM cores WHERE old_field IS NOT NULL AND new_field IS NOT NULL AND old_kind <> new_kind
        UNION ALL SELECT file_no, 'removed', old_field, '' FROM cores c WHERE new_field IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_no = c.file_no AND r.old_field = c.old_field)
        UNION ALL SELECT file_no, 'added', '', new_field FROM cores c WHERE old_field IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_no = c.file_no AND r.new_field = c.new_field)""",
    "p4_statistics": r"""WITH lines AS (SELECT file_no, try_cast(payload AS json) AS j FROM metadata_line),
        nodes AS (SELECT l.file_no, substr(t.fullkey, 3) AS path, t.type, t.parent IS NULL AS root, t.path AS above FROM lines l, json_tree(l.j) t WHERE json_type(l.j) = 'OBJECT'),
        kinds AS (
            SELECT file_no, replace(path, '"', '') AS path, CASE type WHEN 'VARCHAR' THEN 'text' WHEN 'UBIGINT' THEN 'whole' WHEN 'BIGINT' THEN 'whole'
                WHEN 'DOUBLE' THEN 'point' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' END AS kind
            FROM nodes WHERE NOT root AND path NOT LIKE '%[%'
        )
        SELECT path, kind, CAST(count(*) AS bigint) AS n_values, CAST(count(DISTINCT file_no) AS bigint) AS n_files FROM kinds WHERE kind IS NOT NULL GROUP BY ALL""",
    "p4_table": f"""WITH {_CELLS},
        kept AS (
            SELECT *, dtype <> 'json' AND spelling = 1 AND unread AS failed, spelling > 1 OR (dtype <> 'json' AND (t IN ('ARRAY', 'OBJECT') OR unread)) AS unheld
            FROM (SELECT *, CASE dtype WHEN 'double' THEN try_cast(v AS double) IS NULL WHEN 'bigint' THEN try_cast(v AS bigint) IS NULL WHEN 'boolean' THEN try_cast(v AS boolean) IS NULL ELSE false END AS unread FROM valued)
        ),
        notes AS (
            SELECT line_key, string_agg(field, ',' ORDER BY field) FILTER (failed) AS failed_casts, string_agg(field || '=' || CAST(raw AS varchar), chr(10) ORDER BY field || '=' || CAST(raw AS varchar)) FILTER (unheld) AS rest
            FROM kept GROUP BY line_key
        ),
        {", ".join(f"{k}_wide AS (PIVOT (WITH {_CELLS} SELECT line_key, core, TRY_CAST(v AS {sql}) AS v FROM valued WHERE spelling = 1 AND dtype = '{k}') ON core USING any_value(v) GROUP BY line_key)" for k, sql in _COLUMN_TYPES)}
        SELECT lines.file_no, * EXCLUDE (file_no, j, failed_casts, rest), coalesce(failed_casts, '') AS failed_casts, CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(rest, '') END AS rest
        FROM lines {" ".join(f"LEFT JOIN {k}_wide USING (line_key)" for k, _ in _COLUMN_TYPES)} LEFT JOIN notes USING (line_key)""",
    "p5_found": r"""WITH pieces AS (SELECT unnest(regexp_extract_all(body, '\{[^{}]*\}')) AS piece FROM tiny_file),
        records AS (SELECT try_cast(piece AS json) AS j FROM pieces)
        SELECT DISTINCT j->>'href' AS href, trim(j->>'etag', '"') AS etag FROM records WHERE json_type(j, '$.href') = 'VARCHAR' AND json_type(j, '$.etag') = 'VARCHAR'""",
    "p5_files": "SELECT file_no, href AS path, CAST(octet_length(encode(body)) AS bigint) AS n_bytes, md5(body) AS digest FROM tiny_file",
    "p5_lookup": "SELECT file_no, href AS path, md5(body) AS digest FROM tiny_file WHERE href IN (SELECT href FROM tiny_file WHERE href LIKE '%day=2017-%')",
    "p6_found": f"{_KEYED} SELECT delivery_id FROM ranked WHERE place > 1",
    "p6_kept": f"{_KEYED} SELECT delivery_id, message_id, product, md5(message) AS digest FROM ranked WHERE place = 1",
    "p7_found": f"""WITH {instants('''SELECT record_no AS row_key, 'dataset_record' AS table_name, 'datetime_text' AS field, datetime_text AS text, product FROM dataset_record
            UNION ALL SELECT record_no, 'dataset_record', 'processing_datetime_text', processing_datetime_text, product FROM dataset_record
            UNION ALL SELECT delivery_id, 'sqs_message', 'sent_timestamp', sent_timestamp, product FROM sqs_message''')}
        SELECT table_name, row_key AS row_no, field, utc AS utc_micros FROM read WHERE utc IS NOT NULL AND NOT regexp_matches(text, '{_CANONICAL}')""",
}
