"""SQL fragments shared by the oracles."""

READINGS = """readings AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         'room-' || lpad(CAST(user_id % 20 AS VARCHAR), 3, '0') AS room_id,
         user_id AS device_id,
         CASE event_type WHEN 'view' THEN 'temperature' WHEN 'click' THEN 'humidity'
              WHEN 'purchase' THEN 'occupancy' WHEN 'signup' THEN 'motion'
              WHEN 'error' THEN 'pressure' END AS sensor_type,
         CASE event_type WHEN 'view' THEN value % 40 WHEN 'click' THEN value % 100
              WHEN 'purchase' THEN floor(value % 40) WHEN 'signup' THEN floor(value % 2)
              ELSE value END AS value,
         ts
  FROM events)"""

KIND = """CASE
   WHEN sensor_type = 'temperature' THEN CASE WHEN value >= 30 THEN 'critical_high'
     WHEN value <= 10 THEN 'critical_low' WHEN value > 26 THEN 'high' WHEN value < 18 THEN 'low' END
   WHEN sensor_type = 'humidity' THEN CASE WHEN value >= 80 THEN 'critical_high'
     WHEN value <= 20 THEN 'critical_low' WHEN value > 70 THEN 'high' WHEN value < 30 THEN 'low' END
   WHEN sensor_type = 'occupancy' THEN CASE WHEN value >= 30 THEN 'critical_high'
     WHEN value > 20 THEN 'high' WHEN value < 0 THEN 'low' END END"""

UNIT = """CASE sensor_type WHEN 'temperature' THEN '°C' WHEN 'humidity' THEN '%'
   WHEN 'occupancy' THEN 'people' WHEN 'motion' THEN 'boolean' ELSE 'unknown' END"""

LOG = f"""{READINGS},
kinds AS (SELECT *, {KIND} AS kind FROM readings
  WHERE sensor_type IN ('temperature', 'motion', 'occupancy', 'humidity')),
log AS (SELECT event_id, room_id, device_id, sensor_type, value, ts, kind, {UNIT} AS unit,
  CASE WHEN kind LIKE 'critical%' THEN 'alert' WHEN kind IS NOT NULL THEN 'warning'
       ELSE 'normal' END AS status FROM kinds)"""

ROOMS = f"""{LOG},
rooms AS (SELECT room_id, 'Room ' || room_id AS name,
  coalesce(arg_max(status, (ts, event_id)) FILTER (WHERE status <> 'normal'), 'active') AS status,
  max(ts) AS last_update,
  arg_max(value, (ts, event_id)) FILTER (WHERE sensor_type = 'temperature') AS temperature,
  arg_max(value, (ts, event_id)) FILTER (WHERE sensor_type = 'motion') <> 0 AS motion,
  CAST(trunc(arg_max(value, (ts, event_id)) FILTER (WHERE sensor_type = 'occupancy')) AS INTEGER) AS occupancy,
  arg_max(value, (ts, event_id)) FILTER (WHERE sensor_type = 'humidity') AS humidity,
  count(*) FILTER (WHERE status <> 'normal') AS alert_count_24h
  FROM log GROUP BY room_id)"""

DIMENSION = """dim AS (SELECT 'room-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS room_id,
  n_name AS name, CAST(n_regionkey AS INTEGER) AS floor,
  CASE WHEN n_regionkey <> 4 THEN CAST(n_nationkey + 5 AS INTEGER) END AS capacity FROM nation)"""

REGISTRY = """registry AS (SELECT c_custkey AS device_id, lower(c_mktsegment) AS device_type,
  CASE WHEN c_custkey % 2 = 0 THEN 'free' ELSE 'standard' END AS tier,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'suspended' ELSE 'registered' END AS status,
  'room-' || lpad(CAST(c_custkey % 20 AS VARCHAR), 3, '0') AS location, c_name AS model
  FROM customer)"""


def iso(ts: str = "ts") -> str:
    return f"""strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN ''
  ELSE '.' || lpad(CAST(epoch_us({ts}) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"""


EPOCH = """CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' ||
  CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '0'
       ELSE rtrim(lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END"""


def age(seconds: str) -> str:
    return f"""CASE WHEN {seconds} < 60 THEN CAST({seconds} AS VARCHAR) || 's ago'
      WHEN {seconds} < 3600 THEN CAST({seconds} // 60 AS VARCHAR) || 'm ago'
      WHEN {seconds} >= 3600 THEN CAST({seconds} // 3600 AS VARCHAR) || 'h ago' END"""
