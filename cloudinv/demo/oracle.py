"""DuckDB statements that give the same rows as the registered queries."""

from cloudinv.operators.audit import FORBIDDEN

_HOMES = """
places AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
homes AS (
  SELECT c_custkey, c_name, c_nationkey, c_mktsegment, r_name,
         'vpc-' || c_nationkey || '-' || c_mktsegment AS vpc_id
  FROM customer JOIN places ON c_nationkey = n_nationkey)"""

_COLUMNS = (
    "account_id, arn, resource_type, resource_id, resource_name, aws_region, "
    "tags, relationships, configuration"
)


def _rows(resource_type, nation, resource_id, source, configuration,
          name="NULL", tags="NULL", relationships="NULL"):
    kind = resource_type.rsplit("::", 1)[-1].lower()
    return f"""
  SELECT lpad(({nation})::VARCHAR, 12, '0') AS account_id,
         'arn:{kind}/' || ({resource_id}) AS arn, '{resource_type}' AS resource_type,
         ({resource_id})::VARCHAR AS resource_id, ({name})::VARCHAR AS resource_name,
         r_name AS aws_region, ({tags})::VARCHAR AS tags,
         ({relationships})::VARCHAR AS relationships, ({configuration})::VARCHAR AS configuration
  FROM {source}"""


def _relation(target, resource_id, name):
    return f"{{resourceId: {resource_id}, resourceType: '{target}', name: '{name}'}}"


_PLACED = "(SELECT *, ({key} % 25)::INT AS nation FROM {table}) JOIN places ON nation = n_nationkey"
_ENV = "to_json({Environment: c_mktsegment})"

_ITEMS = {
    "vpc": _rows(
        "AWS::EC2::VPC", "c_nationkey", "vpc_id",
        "(SELECT DISTINCT vpc_id, c_nationkey, c_mktsegment, r_name FROM homes)",
        "to_json({vpcId: vpc_id, cidrBlock: '10.' || c_nationkey || '.0.0/16'})",
        name="c_mktsegment", tags=_ENV,
    ),
    "subnet": _rows(
        "AWS::EC2::Subnet", "c_nationkey", "'subnet-' || c_custkey", "homes",
        "to_json({vpcId: vpc_id, cidrBlock: '10.' || c_nationkey || '.' || (c_custkey % 256) || '.0/24',"
        " availabilityZone: r_name || '-a'})",
        name="c_name", tags=_ENV,
        relationships="to_json([" + _relation("AWS::EC2::VPC", "vpc_id", "Is contained in Vpc") + "])",
    ),
    "instance": _rows(
        "AWS::EC2::Instance", "c_nationkey", "'i-' || o_orderkey",
        "orders JOIN homes ON o_custkey = c_custkey",
        "to_json({subnetId: CASE WHEN o_custkey % 7 <> 0 THEN 'subnet-' || o_custkey END, vpcId: vpc_id, instanceType: o_orderpriority,"
        " state: {name: o_orderstatus}})",
        name="'order ' || o_orderkey", tags=_ENV,
        relationships="to_json(["
        + _relation("AWS::EC2::VPC", "vpc_id", "Is contained in Vpc") + ", "
        + _relation("AWS::EC2::Subnet", "'subnet-' || o_custkey", "Is contained in Subnet") + "])",
    ),
    "volume": _rows(
        "AWS::EC2::Volume", "c_nationkey",
        "'vol-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey",
        "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN homes ON o_custkey = c_custkey",
        "to_json({size: l_quantity::INT, volumeType: l_returnflag, encrypted: l_linestatus = 'F',"
        " state: {value: CASE WHEN l_linestatus = 'O' THEN 'in-use' ELSE 'available' END},"
        " kmsKeyId: CASE WHEN l_linestatus = 'F' AND l_quantity >= 45 THEN 'key-' || l_partkey END,"
        " attachments: [{instanceId: 'i-' || l_orderkey, device: '/dev/sd' || l_linenumber,"
        " deleteOnTermination: l_linenumber = 1}]})",
        relationships="to_json(["
        + _relation("AWS::EC2::Instance", "'i-' || l_orderkey", "Is attached to Instance") + "])",
    ),
    "interface": _rows(
        "AWS::EC2::NetworkInterface", "c_nationkey", "'eni-' || event_id",
        "events JOIN homes ON user_id = c_custkey",
        "to_json({subnetId: CASE WHEN user_id % 7 <> 0 THEN 'subnet-' || user_id END, vpcId: vpc_id, status: event_type})",
        relationships="to_json(["
        + _relation("AWS::EC2::Subnet", "'subnet-' || user_id", "Is contained in Subnet") + ", "
        + _relation("AWS::EC2::VPC", "vpc_id", "Is contained in Vpc") + "])",
    ),
    "key": _rows(
        "AWS::KMS::Key", "nation", "'key-' || p_partkey",
        _PLACED.format(key="p_partkey", table="part"),
        "to_json({keyState: CASE WHEN p_size > 40 THEN 'Disabled' ELSE 'Enabled' END})",
        name="p_name",
    ),
    "role": _rows(
        "AWS::IAM::Role", "s_nationkey", "s_suppkey",
        "supplier JOIN places ON s_nationkey = n_nationkey",
        "to_json({trust: {Service: CASE WHEN s_acctbal > 5000 THEN 'EC2.amazonaws.com'"
        " ELSE 'lambda.amazonaws.com' END, Action: 'sts:AssumeRole'}})",
        name="s_name",
    ),
    "function": _rows(
        "AWS::Lambda::Function", "nation", "'fn-' || p_partkey",
        _PLACED.format(key="p_partkey", table="part"),
        "to_json({runtime: p_brand, role: 'arn:role/' || (p_partkey % 10),"
        " vpcConfig: {vpcId: 'vpc-' || nation || '-MACHINERY'}})",
        name="p_name",
        relationships="to_json(["
        + _relation("AWS::IAM::Role", "(p_partkey % 10)::VARCHAR", "Is associated with IAM Role") + "])",
    ),
    "database": _rows(
        "AWS::RDS::DBInstance", "nation", "'db-' || doc_id",
        _PLACED.format(key="doc_id", table="documents"),
        "to_json({engine: source, engineVersion: lang, dbSubnetGroup: {vpcId: 'vpc-' || nation ||"
        " '-HOUSEHOLD'}, kmsKeyId: CASE WHEN lang = 'en' THEN 'key-' || doc_id END})",
    ),
    "bucket": _rows(
        "AWS::S3::Bucket", "nation", "'b-' || page_id",
        _PLACED.format(key="page_id", table="pages"),
        "to_json({bytes: length(html)})",
        name="url",
        relationships="to_json(["
        + _relation("AWS::KMS::Key", "'key-' || page_id", "Is encrypted by KMS Key") + "])",
    ),
}


def _live(*kinds, then):
    """A statement over live rows of some kinds, or of all."""
    chosen = " UNION ALL ".join(_ITEMS[k] for k in (kinds or _ITEMS))
    extra = f"WITH {_HOMES},\nlive AS (SELECT *, TIMESTAMP '2026-04-09 09:00:00' AS last_seen_at FROM ({chosen}))"
    return f"{extra}{then}"


def _q(*kinds, sql, ctes=""):
    return _live(*kinds, then=(",\n" + ctes if ctes else "") + "\n" + sql)


def _s(path, column="configuration"):
    return f"json_extract_string({column}, '{path}')"


_OBS = """
obs AS (
  SELECT lpad((user_id % 25)::VARCHAR, 12, '0') AS account_id,
         'arn:event/' || user_id || '/' || event_type AS arn,
         event_type AS resource_type, NULL::VARCHAR AS aws_region, md5(props) AS state_hash,
         ts AS last_seen_at, ts AS captured_at, 'event/' || event_id AS source_key
  FROM events),
newest AS (SELECT max(ts) AS as_of FROM events)"""

_KEPT = "account_id, arn, source_key, state_hash, last_seen_at"
_RANK = (
    "row_number() OVER (PARTITION BY account_id, arn ORDER BY last_seen_at DESC NULLS LAST,"
    " captured_at DESC NULLS LAST, source_key DESC NULLS LAST)"
)

_CAPTURED = "CASE WHEN event_type = 'signup' THEN NULL ELSE ts END"

_DELIVERED = f"""WITH {_HOMES},
delivered AS (
  SELECT event_id, ts, event_type,
         CASE WHEN event_type <> 'error' THEN lpad(c_nationkey::VARCHAR, 12, '0') END AS account_id,
         CASE WHEN event_type = 'signup' THEN '' ELSE 'arn:networkinterface/eni-' || event_id END AS arn,
         'AWS::EC2::NetworkInterface' AS resource_type, 'eni-' || event_id AS resource_id,
         CASE WHEN event_type <> 'view' THEN 'interface ' || event_id END AS resource_name,
         r_name || '-b' AS availability_zone, ts - INTERVAL 1 DAY AS created_at, TRUE AS from_file,
         to_json([{{resourceId: 'subnet-' || user_id, resourceType: 'AWS::EC2::Subnet',
                    name: 'Is contained in Subnet'}}])::VARCHAR AS relationships,
         r_name AS aws_region, 'OK' AS status, {_CAPTURED} AS captured_at,
         event_id::VARCHAR AS state_id, md5(props) AS state_hash,
         to_json({{'aws:cf:stack': event_type}})::VARCHAR AS tags,
         to_json({{subnetId: 'subnet-' || user_id, vpcId: vpc_id}})::VARCHAR AS configuration,
         '{{}}' AS supplementary_configuration, TIMESTAMP '2026-04-09 09:00:00' AS last_seen_at
  FROM events JOIN homes ON user_id = c_custkey)"""

_ROW = (
    "account_id, arn, resource_type, resource_id, resource_name, aws_region, availability_zone, status,"
    " captured_at, created_at, state_id, state_hash, tags, relationships, configuration,"
    " supplementary_configuration, last_seen_at, from_file"
)
_GOOD = "account_id <> '' AND arn <> ''"

_FIELDS = """
fields AS (
  SELECT p_brand || '-' || (p_partkey // 2500) AS resource_type,
         'configuration.' || p_type || '.' || replace(p_name, ' ', '_') AS path,
         CASE WHEN max(p_size) > 25 THEN 'integer' ELSE 'string' END AS type
  FROM part GROUP BY 1, 2),
notable AS (
  SELECT DISTINCT p_brand || '-' || (p_partkey // 2500) AS resource_type, p_type,
         'configuration.' || p_type || '.' || replace(p_name, ' ', '_')
         || CASE WHEN p_size > 48 THEN '.missing' ELSE '' END AS path
  FROM part)"""

_DOCS = f"""{_FIELDS},
kinds AS (
  SELECT resource_type, min(p_type) AS category, string_agg(p_type, ' and ' ORDER BY p_type) AS description,
         string_agg('- how many ' || p_type, chr(10) ORDER BY p_type) AS asked
  FROM (SELECT DISTINCT resource_type, p_type FROM notable) GROUP BY 1),
noted AS (
  SELECT resource_type, string_agg('- `' || path || '` — noted', chr(10) ORDER BY path) AS noted
  FROM (SELECT DISTINCT resource_type, path FROM notable) GROUP BY 1),
listed AS (
  SELECT resource_type, count(*) AS n,
         string_agg('- `' || path || '`: ' || type || chr(10), '' ORDER BY path) AS listed
  FROM fields GROUP BY 1)"""

_CENTRES = """
centres AS (
  SELECT label AS query_id, list(x ORDER BY i) AS q
  FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x
        FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
        GROUP BY label, i)
  GROUP BY label)"""


def _topk(k, where="TRUE"):
    return f"""{_CENTRES},
near AS (
  SELECT query_id, vec_id AS key, label AS service,
         round(list_cosine_distance(embedding::DOUBLE[], q), 10) AS d
  FROM embeddings, centres WHERE {where}),
matches AS (
  SELECT query_id, key, service, round(d, 4) AS distance, rank::INTEGER AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, key) AS rank FROM near)
  WHERE rank <= {k})"""


_ANSWERS = """
answers AS (
  SELECT conv_id, turn, CASE
    WHEN role = 'system' THEN text
    WHEN role = 'user' AND turn = 0 THEN '```sql' || chr(10) || '-- cannot answer: ' || text || chr(10) || '```'
    WHEN role = 'user' THEN 'Here:' || chr(10) || '```SQL' || chr(10) || '  WITH t AS (SELECT 1) SELECT '''
      || text || ''' AS note FROM t;;' || chr(10) || '```' || chr(10) || '```sql' || chr(10) || 'DROP x```'
    WHEN turn = 1 THEN '```' || chr(10) || 'DELETE FROM t WHERE note = ''' || text || '''' || chr(10) || '```'
    WHEN turn = 3 THEN '```sql' || chr(10) || 'SELECT * FROM t WHERE note = ''' || text || '''; update t```'
    ELSE '```sql' || chr(10) || 'select * FROM t WHERE note = ''' || text || '''' || chr(10) || '```'
    END AS answer
  FROM conversations),
extracted AS (
  SELECT conv_id, turn,
         CASE WHEN regexp_matches(answer, '(?is)```(?:sql)?\\s*(.+?)```') THEN
           regexp_replace(regexp_replace(regexp_extract(answer, '(?is)```(?:sql)?\\s*(.+?)```', 1),
             '^\\s+|\\s+$', '', 'g'), ';+$', '') END AS sql
  FROM answers)"""

_FORBIDDEN = FORBIDDEN.replace("(?iU)", "(?i)")

_JOBS = """
tenths AS (SELECT *, floor(value * 10)::BIGINT AS t,
                  CASE WHEN event_type = 'error' THEN event_id % 4 ELSE 4 END AS stop FROM events),
jobs AS (
  SELECT 'job-' || event_id AS job_id,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status,
         CASE WHEN stop > 0 THEN t / 10.0::DOUBLE END AS embed_ms,
         CASE WHEN stop > 1 THEN (t * 2 % 9973) / 10.0::DOUBLE END AS retrieve_ms,
         CASE WHEN stop > 2 THEN (t * 7 % 60013) / 10.0::DOUBLE END AS generate_ms,
         CASE WHEN stop > 3 THEN (t * 13 % 70001) / 10.0::DOUBLE END AS athena_ms,
         CASE WHEN stop < 4 THEN ['embed', 'retrieve', 'generate', 'athena'][stop + 1] END AS stage,
         CASE WHEN value > 20 THEN 'TimeoutError' ELSE 'RuntimeError' END AS error
  FROM tenths)"""


def _top(select, order, limit):
    return f"{select} ORDER BY {order} LIMIT {limit}"


_BY_TYPE = "SELECT resource_type, count(*) AS resource_count FROM live GROUP BY 1"
_BY_ACCOUNT = (
    "SELECT account_id, count(*) AS resource_count,"
    " count(DISTINCT resource_type) AS distinct_resource_types,"
    " count(DISTINCT aws_region) AS distinct_regions FROM live GROUP BY 1"
)
_OVERVIEW = (
    "SELECT count(*) AS total_resources, count(DISTINCT account_id) AS distinct_accounts,"
    " count(DISTINCT resource_type) AS distinct_resource_types,"
    " count(DISTINCT aws_region) AS distinct_regions,"
    " min(last_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM "
)
# From the given tables, not from the JSON texts that are derived from them.
_ACCOUNT = "lpad(({})::VARCHAR, 12, '0')"
_OCCUPANCY = f"""WITH {_HOMES},
machines AS (SELECT o_custkey AS owner, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1),
cards AS (SELECT user_id AS owner, count(*) AS n FROM events WHERE user_id % 7 <> 0 GROUP BY 1),
occupancy AS (
  SELECT 'subnet-' || c_custkey AS subnet_id, c_name AS subnet_name,
         {_ACCOUNT.format("c_nationkey")} AS account_id, r_name AS aws_region, r_name || '-a' AS az, vpc_id,
         '10.' || c_nationkey || '.' || (c_custkey % 256) || '.0/24' AS cidr_block,
         coalesce(machines.n, 0) AS ec2_instance_count, coalesce(cards.n, 0) AS network_interface_count,
         coalesce(machines.n, 0) + coalesce(cards.n, 0) AS total_resources
  FROM homes LEFT JOIN machines ON machines.owner = c_custkey LEFT JOIN cards ON cards.owner = c_custkey)
"""
_VPCS = f"""WITH {_HOMES},
members AS (
  SELECT 'machine' AS kind, c_nationkey AS place, c_mktsegment AS segment
  FROM orders JOIN homes ON o_custkey = c_custkey
  UNION ALL SELECT 'card', c_nationkey, c_mktsegment FROM events JOIN homes ON user_id = c_custkey
  UNION ALL SELECT 'code', p_partkey % 25, 'MACHINERY' FROM part
  UNION ALL SELECT 'base', doc_id % 25, 'HOUSEHOLD' FROM documents),
networks AS (SELECT DISTINCT c_nationkey, c_mktsegment, r_name FROM homes),
tally AS (
  SELECT place, segment, count(*) AS n, sum((kind = 'machine')::INT) AS a, sum((kind = 'base')::INT) AS b,
         sum((kind = 'code')::INT) AS c, sum((kind = 'card')::INT) AS d FROM members GROUP BY place, segment),
inventory AS (
  SELECT 'vpc-' || place || '-' || segment AS vpc_id, {_ACCOUNT.format("place")} AS account_id,
         r_name AS aws_region, '10.' || c_nationkey || '.0.0/16' AS cidr_block,
         a::BIGINT AS ec2_instances, b::BIGINT AS rds_instances, c::BIGINT AS lambda_functions,
         d::BIGINT AS network_interfaces, n AS total_resource_count
  FROM tally LEFT JOIN networks ON c_nationkey = place AND c_mktsegment = segment)
"""
_INSTANCE_VOLUMES = f"""WITH {_HOMES},
attached AS (
  SELECT {_ACCOUNT.format("c_nationkey")} AS account_id, r_name AS aws_region, 'i-' || o_orderkey AS instance_id,
         'order ' || o_orderkey AS instance_name, o_orderstatus AS instance_state,
         o_orderpriority AS instance_type,
         'vol-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS volume_id,
         l_returnflag AS volume_type, l_quantity::INT AS size_gib,
         CASE WHEN l_linestatus = 'O' THEN 'in-use' ELSE 'available' END AS volume_state,
         (l_linestatus = 'F')::VARCHAR AS encrypted, '/dev/sd' || l_linenumber AS device_name,
         (l_linenumber = 1)::VARCHAR AS delete_on_termination
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN homes ON o_custkey = c_custkey)
SELECT * FROM attached"""


def _pointing(source, name, target, nation, source_id, target_id, found, table):
    return f"""
  SELECT {_ACCOUNT.format(nation)} AS account_id, '{target}' AS target_type, ({target_id})::VARCHAR AS target_id,
         '{source}' AS source_type, ({source_id})::VARCHAR AS source_id, '{name}' AS name,
         CASE WHEN {found} THEN 'arn:{target.rsplit("::", 1)[-1].lower()}/' || ({target_id}) END AS target_arn
  FROM {table}"""


_IN_VPC, _IN_SUBNET = "Is contained in Vpc", "Is contained in Subnet"
_ORDERED = "orders JOIN homes ON o_custkey = c_custkey"
_SEEN = "events JOIN homes ON user_id = c_custkey"
_RESOLVED = f"WITH {_HOMES}" + " UNION ALL ".join([
    _pointing("AWS::EC2::Subnet", _IN_VPC, "AWS::EC2::VPC", "c_nationkey", "'subnet-' || c_custkey", "vpc_id", "TRUE", "homes"),
    _pointing("AWS::EC2::Instance", _IN_VPC, "AWS::EC2::VPC", "c_nationkey", "'i-' || o_orderkey", "vpc_id", "TRUE", _ORDERED),
    _pointing("AWS::EC2::Instance", _IN_SUBNET, "AWS::EC2::Subnet", "c_nationkey", "'i-' || o_orderkey",
              "'subnet-' || o_custkey", "TRUE", _ORDERED),
    _pointing("AWS::EC2::Volume", "Is attached to Instance", "AWS::EC2::Instance", "c_nationkey",
              "'vol-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey",
              "'i-' || l_orderkey", "TRUE", "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN homes ON o_custkey = c_custkey"),
    _pointing("AWS::EC2::NetworkInterface", _IN_SUBNET, "AWS::EC2::Subnet", "c_nationkey", "'eni-' || event_id",
              "'subnet-' || user_id", "TRUE", _SEEN),
    _pointing("AWS::EC2::NetworkInterface", _IN_VPC, "AWS::EC2::VPC", "c_nationkey", "'eni-' || event_id", "vpc_id", "TRUE", _SEEN),
    _pointing("AWS::Lambda::Function", "Is associated with IAM Role", "AWS::IAM::Role", "p_partkey % 25", "'fn-' || p_partkey",
              "p_partkey % 10", "s_suppkey IS NOT NULL",
              "part LEFT JOIN supplier ON s_suppkey = p_partkey % 10 AND s_nationkey = p_partkey % 25"),
    _pointing("AWS::S3::Bucket", "Is encrypted by KMS Key", "AWS::KMS::Key", "page_id % 25", "'b-' || page_id",
              "'key-' || page_id", "p_partkey IS NOT NULL", "pages LEFT JOIN part ON p_partkey = page_id"),
])

_MERGE_UPDATE = f"""WITH {_OBS},
target AS (SELECT * FROM obs WHERE last_seen_at < TIMESTAMP '2024-01-16'),
source AS (
  SELECT * FROM (SELECT *, {_RANK} AS rn FROM obs
    WHERE last_seen_at >= TIMESTAMP '2024-01-16')
  WHERE rn = 1)
SELECT t.account_id, t.arn,
       CASE WHEN t.last_seen_at < s.last_seen_at THEN s.source_key ELSE t.source_key END AS source_key,
       CASE WHEN t.last_seen_at < s.last_seen_at THEN s.state_hash ELSE t.state_hash END AS state_hash,
       CASE WHEN t.last_seen_at < s.last_seen_at THEN s.last_seen_at ELSE t.last_seen_at END AS last_seen_at
FROM target t LEFT JOIN source s ON t.account_id = s.account_id AND t.arn = s.arn
UNION ALL
SELECT {_KEPT} FROM source s WHERE NOT EXISTS (
  SELECT 1 FROM target t WHERE t.account_id = s.account_id AND t.arn = s.arn)"""

_LATEST = f"SELECT {_KEPT} FROM (SELECT *, {_RANK} AS rn FROM obs) WHERE rn = 1"

ORACLE: dict[str, str] = {
    "s1_read_snapshots": f"{_DELIVERED} SELECT {_ROW} FROM delivered WHERE {_GOOD}",
    "s1_read_by_item": f"{_DELIVERED} SELECT {_ROW} FROM delivered WHERE {_GOOD}",
    "s1_broken_files": "SELECT count(*) AS items, (SELECT count(DISTINCT lang) FROM documents) AS bad_files"
    " FROM events JOIN customer ON user_id = c_custkey",
    "s2_read_one_day": f"{_DELIVERED} SELECT {_ROW} FROM delivered WHERE {_GOOD}"
    " AND ts >= TIMESTAMP '2024-01-16'",
    "s3_skip_other_files": f"{_DELIVERED} SELECT TRUE AS snapshot_file, count(*) AS items FROM delivered",
    "s4_quarantine": "SELECT lang, count(*) AS documents FROM documents GROUP BY lang",
    "s5_stream_ingest": f"{_DELIVERED} SELECT {_ROW} FROM delivered WHERE {_GOOD}",
    "s4_redelivery": "SELECT lang, count(*) AS documents, 3 AS attempts, 3::BIGINT AS reads FROM documents GROUP BY lang",
    "s5_events": f"{_DELIVERED} SELECT {_ROW} FROM delivered WHERE {_GOOD}",
    "s6_append": _q(
        "subnet", "interface",
        sql="SELECT account_id, arn, resource_type, md5(configuration) AS state_hash,"
        " configuration, relationships FROM live",
    ),
    "s7_export_parquet": _q(
        "interface", "key",
        sql="SELECT account_id, resource_type, count(*) AS n FROM live"
        " WHERE (resource_type = 'AWS::KMS::Key') = (aws_region = 'ASIA') GROUP BY 1, 2",
    ),
    "s8_count_export": _q("interface", sql="SELECT count(*) AS rows FROM live"),
    "s9_unpack_lines": f"{_DELIVERED} SELECT resource_id, account_id, configuration FROM delivered"
    " WHERE ts < TIMESTAMP '2024-01-16'",
    "s9_lines_by_item": f"{_DELIVERED} SELECT resource_id, account_id, configuration FROM delivered"
    " WHERE ts < TIMESTAMP '2024-01-16'",
    "s10_schema_fields": f"WITH {_FIELDS} SELECT resource_type, path, type FROM fields",
    "s11_upsert_vectors": "SELECT vec_id AS key, label AS service, len(embedding)::INT AS dims FROM embeddings"
    " WHERE vec_id NOT IN (SELECT doc_id FROM labels)"
    " UNION ALL SELECT doc_id, quality + 100, 2 FROM labels",
    "s12_ingest_log": f"{_DELIVERED}, files AS (SELECT 2 * ceil((SELECT count(*) FROM events) / 2000.0)"
    " + (SELECT count(DISTINCT lang) FROM documents) AS n)"
    " SELECT (SELECT ceil(n / 4)::BIGINT FROM files) AS batches, (SELECT n::BIGINT FROM files) AS files,"
    f" count(*) FILTER (WHERE {_GOOD}) AS rows,"
    f" count(*) FILTER (WHERE ({_GOOD}) IS NOT TRUE) AS dropped,"
    " (SELECT count(DISTINCT lang) FROM documents) AS bad_files,"
    " count(DISTINCT resource_type) AS types FROM delivered",
    "p1_explode_items": f"{_DELIVERED} SELECT account_id, arn, resource_id, state_id FROM delivered",
    "p2_flatten_items": f"{_DELIVERED} SELECT {_ROW} FROM delivered WHERE {_GOOD}",
    "p3_drop_unidentified": f"{_DELIVERED} SELECT event_type AS stack, count(*) AS items FROM delivered"
    f" WHERE {_GOOD} GROUP BY 1",
    "p3b_lenient_flatten": f"{_DELIVERED} SELECT {_ROW.removesuffix(', from_file')} FROM delivered"
    " WHERE account_id IS NOT NULL",
    "p4_parse_ts": f"SELECT event_id, {_CAPTURED} AS captured_at FROM events",
    "p5_json_text": f"{_DELIVERED} SELECT resource_id, tags, relationships, configuration,"
    " supplementary_configuration FROM delivered",
    "p6_stamps": f"{_DELIVERED} SELECT resource_id, last_seen_at, TRUE AS has_source FROM delivered"
    f" WHERE {_GOOD}",
    "f10_decoded_paths": "SELECT page_id, 's3://bucket/a+b/' || url || ' é+%/c.json.gz' AS path FROM pages",
    "p7_live": f"WITH {_OBS} SELECT account_id, arn, source_key, last_seen_at FROM obs, newest"
    " WHERE last_seen_at > as_of - INTERVAL 24 HOUR",
    "p8_of_type": _q(
        "subnet", "vpc", "role",
        sql="SELECT resource_type, account_id, resource_id, resource_name FROM live",
    ),
    "p9_has_value": _q(
        "volume", "database",
        sql=f"SELECT resource_id, {_s('$.kmsKeyId')} AS key_id FROM live"
        f" WHERE {_s('$.kmsKeyId')} IS NOT NULL AND {_s('$.kmsKeyId')} <> ''",
    ),
    "p10_search_text": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the')"
    " AND contains(lower(text), 'tion') AND contains(text, '%')",
    "p11_probe_fields": _q(
        "volume",
        sql=f"SELECT account_id, resource_id, {_s('$.encrypted')} AS encrypted,"
        f" {_s('$.kmsKeyId')} AS kms_key_id, {_s('$.volumeType')} AS volume_type,"
        f" {_s('$.state.value')} AS state FROM live",
    ),
    "m1_latest": f"WITH {_OBS} {_LATEST}",
    "m1_live_latest": f"WITH {_OBS} {_LATEST} AND last_seen_at > (SELECT as_of FROM newest) - INTERVAL 72 HOUR",
    "m2_merge_collapse": f"WITH {_OBS} {_LATEST}",
    "m2_merge_update": _MERGE_UPDATE,
    "m2_merge_buckets": f"WITH {_OBS} {_LATEST}",
    "m3_drop_expired": f"WITH {_OBS} SELECT {_KEPT} FROM obs, newest WHERE last_seen_at IS NULL"
    " OR last_seen_at >= as_of - INTERVAL 7 DAY",
    "m4_compact_files": f"WITH {_OBS} SELECT {_KEPT} FROM obs",
    "m5_nightly": f"WITH {_OBS} SELECT {_KEPT} FROM ({_LATEST}), newest"
    " WHERE last_seen_at >= as_of - INTERVAL 7 DAY",
    "m6_expired_files": "SELECT * FROM (SELECT 's3://' || event_type || '/' || user_id || '/click/' || event_id"
    " AS path, ts AS modified_at, CASE WHEN event_type = 'click' AND user_id::VARCHAR LIKE '1%' THEN 3"
    " WHEN event_type = 'click' THEN 14 WHEN event_type = 'view' THEN 7"
    " WHEN event_type = 'purchase' THEN 1 END AS days FROM events)"
    " WHERE modified_at < TIMESTAMP '2024-01-20' - to_days(days)",
    "m6_listed_files": "SELECT 3 AS days, ceil(count(*) / 2000.0)::BIGINT AS files FROM events"
    " UNION ALL SELECT 30, ceil((SELECT count(*) FROM events) / 2000.0)::BIGINT + count(DISTINCT lang) FROM documents",
    "a1_overview": _q(sql=f"{_OVERVIEW} live"),
    "a1_overview_observed": f"WITH {_OBS} {_OVERVIEW} obs WHERE last_seen_at >"
    " (SELECT as_of FROM newest) - INTERVAL 240 HOUR",
    "a2_by_type": _q(sql=_top(_BY_TYPE, "resource_count DESC, resource_type", 25)),
    "a2_by_type_three": _q(sql=_top(_BY_TYPE, "resource_count DESC, resource_type", 3)),
    "a3_by_account": _q(sql=_top(_BY_ACCOUNT, "resource_count DESC, account_id", 25)),
    "a4_by_region": _q(
        sql="SELECT aws_region, count(*) AS resource_count, count(DISTINCT account_id) AS"
        " distinct_accounts, count(DISTINCT resource_type) AS distinct_resource_types"
        " FROM live GROUP BY 1 ORDER BY resource_count DESC, aws_region"
    ),
    "a5_totals": _q(
        sql="SELECT count(*) AS rows, count(DISTINCT account_id) AS accounts,"
        " count(DISTINCT resource_type) AS types FROM live"
    ),
    "a6_top_types": _q(sql=_top(_BY_TYPE, "resource_count DESC, resource_type", 10)),
    "a7_ingest_profile": f"{_DELIVERED} SELECT count(*) AS rows, count(DISTINCT account_id) AS accounts,"
    f" count(DISTINCT resource_type) AS types FROM delivered WHERE {_GOOD}"
    " GROUP BY ts < TIMESTAMP '2024-01-16',"
    " event_id % ceil((SELECT count(*) FROM events) / 2000.0)::BIGINT",
    "q1_type_histogram": _q(sql=_top(_BY_TYPE, "resource_count DESC, resource_type", 15)),
    "q2_instances_per_account": _q(
        "instance",
        sql="SELECT account_id, count(*) AS instance_count FROM live GROUP BY 1"
        " ORDER BY instance_count DESC, account_id LIMIT 10",
    ),
    "q3_top_accounts": _q(
        sql="SELECT account_id, count(*) AS resource_count, count(DISTINCT resource_type) AS"
        " distinct_resource_types FROM live GROUP BY 1 ORDER BY resource_count DESC, account_id LIMIT 10"
    ),
    "q4_largest_volumes": _q(
        "volume",
        sql=f"SELECT resource_id AS volume_id, {_s('$.size')}::INT AS size_gib,"
        f" {_s('$.volumeType')} AS volume_type, {_s('$.encrypted')}::BOOLEAN AS encrypted, account_id"
        " FROM live ORDER BY size_gib DESC NULLS LAST, volume_id, account_id LIMIT 10",
    ),
    "q5_instances_by_tag": _q(
        "instance",
        sql=f"SELECT {_s('$.Environment', 'tags')} AS tag_value, count(*) AS resource_count"
        " FROM live GROUP BY 1 ORDER BY resource_count DESC, tag_value NULLS LAST LIMIT 10",
    ),
    "q5_all_by_tag": _q(
        sql=f"SELECT {_s('$.Environment', 'tags')} AS tag_value, count(*) AS resource_count"
        " FROM live GROUP BY 1 ORDER BY resource_count DESC, tag_value NULLS LAST LIMIT 10",
    ),
    "q6_functions_by_runtime": _q(
        "function",
        sql=f"SELECT {_s('$.runtime')} AS runtime, count(*) AS function_count FROM live GROUP BY 1",
    ),
    "q7_engines_by_version": _q(
        "database",
        sql=f"SELECT {_s('$.engine')} AS engine, {_s('$.engineVersion')} AS engine_version,"
        " count(*) AS instance_count FROM live GROUP BY 1, 2",
    ),
    "q8_instance_volumes": f"{_INSTANCE_VOLUMES} ORDER BY instance_id, device_name NULLS LAST, volume_id,"
    " account_id LIMIT 20",
    "q8_instance_volumes_all": _INSTANCE_VOLUMES,
    "q9_function_roles": f"""WITH {_HOMES}
SELECT {_ACCOUNT.format("p_partkey % 25")} AS account_id, 'fn-' || p_partkey AS function_id, p_name AS function_name,
       p_brand AS runtime, 'arn:role/' || s_suppkey AS role_arn, s_name AS role_name,
       {_ACCOUNT.format("s_nationkey")} AS role_account_id
FROM part JOIN supplier ON s_suppkey = p_partkey % 10""",
    "q10_volume_keys": f"""WITH {_HOMES}
SELECT {_ACCOUNT.format("c_nationkey")} AS account_id,
       'vol-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS volume_id,
       'key-' || p_partkey AS key_id, 'arn:key/key-' || p_partkey AS key_arn,
       {_ACCOUNT.format("p_partkey % 25")} AS key_account_id,
       CASE WHEN p_size > 40 THEN 'Disabled' ELSE 'Enabled' END AS key_state
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN homes ON o_custkey = c_custkey
JOIN part ON p_partkey = l_partkey
WHERE l_linestatus = 'F' AND l_quantity >= 45""",
    "q11_subnet_occupancy": f"{_OCCUPANCY} SELECT * FROM occupancy",
    "q11_top_subnets": f"{_OCCUPANCY} SELECT * FROM occupancy ORDER BY total_resources DESC, subnet_id, account_id"
    " LIMIT 15",
    "q12_vpc_inventory": f"{_VPCS} SELECT * FROM inventory",
    "q12_top_vpcs": f"{_VPCS} SELECT * FROM inventory ORDER BY total_resource_count DESC, vpc_id, account_id,"
    " aws_region NULLS LAST, cidr_block NULLS LAST LIMIT 20",
    "q13_orphan_keys": _q(
        "key", "volume", "database", "bucket",
        ctes=f"""used AS (
  SELECT {_s('$.kmsKeyId')} AS key_id FROM live
  WHERE resource_type IN ('AWS::EC2::Volume', 'AWS::RDS::DBInstance')
  UNION SELECT {_s('$[0].resourceId', 'relationships')} FROM live WHERE resource_type = 'AWS::S3::Bucket')""",
        sql=f"SELECT resource_id AS key_id, account_id, {_s('$.keyState')} AS key_state FROM live k"
        " LEFT JOIN used ON k.resource_id = used.key_id"
        " WHERE k.resource_type = 'AWS::KMS::Key' AND used.key_id IS NULL",
    ),
    "q14_empty_subnets": f"{_OCCUPANCY} SELECT account_id, subnet_id, subnet_name AS resource_name"
    " FROM occupancy WHERE total_resources = 0",
    "q14_subnets_without_interfaces": f"{_OCCUPANCY} SELECT account_id, subnet_id, subnet_name AS resource_name"
    " FROM occupancy WHERE network_interface_count = 0",
    "q15_roles_trusting": _q(
        "role",
        sql="SELECT account_id, arn, resource_name FROM live"
        " WHERE lower(configuration) LIKE '%ec2.amazonaws.com%'"
        " AND lower(configuration) LIKE '%sts:assumerole%'",
    ),
    "q16_resolved_edges": _RESOLVED,
    "q16_edge_counts": "SELECT source_type, name, target_type, count(*) AS edge_count,"
    f" count(target_arn) AS resolved_count FROM ({_RESOLVED}) GROUP BY 1, 2, 3",
    "q17_state_changes": f"""WITH {_OBS}
SELECT account_id, arn, last_seen_at AS changed_at, before AS previous_state, state_hash AS current_state
FROM (SELECT *, lag(state_hash) OVER w AS before, row_number() OVER w AS rn FROM obs
      WINDOW w AS (PARTITION BY account_id, arn ORDER BY last_seen_at, source_key, state_hash))
WHERE rn > 1 AND before IS DISTINCT FROM state_hash""",
    "v1_cosine_topk": f"WITH {_topk(5)} SELECT * FROM matches",
    "v2_normalize": "SELECT vec_id, 1.0::DOUBLE AS length,"
    " round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS first,"
    " round(embedding[-1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS last"
    " FROM embeddings",
    "v3_cosine_topk_where": f"WITH {_topk(3, 'label IN (2, 3, 5, 7)')} SELECT * FROM matches",
    "v4_render_docs": f"""WITH {_DOCS}
SELECT k.resource_type,
  '# ' || k.resource_type || chr(10) || chr(10) || '- **Service**: svc-' || k.resource_type || chr(10)
  || '- **Category**: ' || category || chr(10) || '- **Field count**: ' || n || chr(10) || chr(10)
  || '## Description' || chr(10) || chr(10) || description || chr(10) || chr(10)
  || '## Common queries' || chr(10) || chr(10) || asked || chr(10) || chr(10)
  || '## Notable fields' || chr(10) || chr(10) || noted || chr(10) || chr(10)
  || '## All field paths' || chr(10) || chr(10) || listed AS document
FROM kinds k JOIN noted USING (resource_type) JOIN listed USING (resource_type)""",
    "v5_doc_metadata": f"WITH {_DOCS} SELECT resource_type, 'svc-' || resource_type AS service, category,"
    " n::INT AS field_count FROM kinds JOIN listed USING (resource_type)",
    "v6_pending": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "v7_invalid_paths": f"WITH {_FIELDS} SELECT DISTINCT n.resource_type, n.path FROM notable n"
    " LEFT JOIN fields f ON n.resource_type = f.resource_type AND n.path = f.path WHERE f.path IS NULL",
    "v8_context": f"""WITH {_topk(5)},
docs AS (SELECT 2 * doc_id AS doc_id, text FROM documents)
SELECT query_id, string_agg(
  coalesce(text, '# ' || key || chr(10) || chr(10) || '_(no enriched doc bundled)_' || chr(10)),
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM matches LEFT JOIN docs ON key = doc_id GROUP BY query_id""",
    "g1_extract_sql": f"WITH {_ANSWERS} SELECT conv_id, turn, sql FROM extracted",
    "g2_validate_sql": f"""WITH {_ANSWERS}
SELECT conv_id, turn, CASE
  WHEN sql IS NULL THEN 'no_block'
  WHEN starts_with(trim(sql), '--') THEN 'comment'
  WHEN NOT regexp_matches(sql, '(?i)^\\s*(WITH\\s|SELECT\\s)') THEN 'not_select'
  WHEN regexp_matches(sql, '{_FORBIDDEN}') THEN 'forbidden'
  ELSE 'ok' END AS verdict
FROM extracted""",
    "g3_run_readonly": _q(
        "vpc", "subnet", "instance", "volume", "interface",
        sql="SELECT aws_region, resource_type, count(*) AS n FROM live GROUP BY 1, 2",
    ),
    "g3_null_order": _q(
        "instance", "interface",
        sql=f"SELECT aws_region, substr({_s('$.subnetId')}, 8, 1) AS digit, count(*) AS n FROM live"
        " GROUP BY 1, 2 ORDER BY aws_region NULLS LAST, digit NULLS LAST LIMIT 47",
    ),
    "g3_run_json_sql": _q(
        "vpc", "instance",
        sql=f"SELECT {_s('$.Environment', 'm.tags')} AS environment, {_s('$.cidrBlock', 'n.configuration')} AS cidr,"
        f" count(*) AS machines, count(*) FILTER (WHERE {_s('$.state.name', 'm.configuration')} = 'F') AS stopped"
        f" FROM live m JOIN live n ON {_s('$.vpcId', 'm.configuration')} = n.resource_id"
        " AND m.account_id = n.account_id WHERE m.resource_type = 'AWS::EC2::Instance'"
        " AND n.resource_type = 'AWS::EC2::VPC' GROUP BY 1, 2"
        " ORDER BY machines DESC, environment, cidr LIMIT 50",
    ),
    "g4_stage_timings": f"WITH {_JOBS} SELECT job_id, status, embed_ms, retrieve_ms, generate_ms, athena_ms,"
    " round(coalesce(embed_ms, 0) + coalesce(retrieve_ms, 0) + coalesce(generate_ms, 0)"
    " + coalesce(athena_ms, 0), 1) AS total_ms FROM jobs",
    "g4_stage_rows": f"""WITH {_JOBS},
listed AS (
  SELECT job_id, n, ['embed', 'retrieve', 'generate', 'athena'][n + 1] AS stage, stop,
         [embed_ms, retrieve_ms, generate_ms, athena_ms][n + 1] AS ms
  FROM (SELECT j.*, stop FROM jobs j JOIN tenths t ON j.job_id = 'job-' || t.event_id), range(4) r(n))
SELECT job_id, stage, CASE WHEN n < stop THEN 'done' WHEN n = stop THEN 'failed' ELSE 'pending' END AS status, ms
FROM listed""",
    "g5_timing_report": f"""WITH {_JOBS},
long AS (UNPIVOT (SELECT embed_ms AS embed, retrieve_ms AS retrieve, generate_ms AS generate,
  athena_ms AS athena FROM jobs) ON embed, retrieve, generate, athena INTO NAME stage VALUE ms)
SELECT stage, count(*) AS jobs, round(median(ms), 2) AS median_ms, min(ms) AS min_ms, max(ms) AS max_ms
FROM long GROUP BY stage""",
    "g6_failures": f"WITH {_JOBS} SELECT stage, error, count(*) AS failed_jobs FROM jobs"
    " WHERE status = 'failed' GROUP BY 1, 2",
}
for _new, _old in (("q4_parsed_volumes", "q4_largest_volumes"), ("q8_parsed_volumes_all", "q8_instance_volumes_all"),
                   ("q12_parsed_vpcs", "q12_top_vpcs")):
    ORACLE[_new] = ORACLE[_old]
