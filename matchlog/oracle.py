"""DuckDB SQL giving the same results as the registered queries.

Written from the definitions, not from the Spark plans: plain window functions over whole
games, self-joins for the two players, sequential updates spelled out step by step.
"""

from __future__ import annotations

from matchlog.plans.assemble import minute_columns
from matchlog.queries import LAST_ROWS, RADIUS, RARE_AFTER, SUPPORT, TOP, TRAIN_GAMES
from matchlog.sources.sample import CENTRES, UNITS
from matchlog.sources.schema import EVENTS, PLAYERS, SPECIES

ORACLE: dict[str, str] = {}

_LOG = """
e AS (
  SELECT CAST(user_id AS INT) AS game_id, CAST(user_id % 2 AS INT) AS winner, event_id AS seq,
    (epoch_us(ts) - 1704067200000000) / 86400000000.0e0 AS time,
    CAST(event_id % 2 AS INT) AS player,
    CASE (user_id * 2 + event_id % 2) % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'P' ELSE 'Z' END AS species,
    CASE event_type WHEN 'view' THEN 'Camera' WHEN 'click' THEN 'Right Click'
      WHEN 'purchase' THEN 'Ability' WHEN 'signup' THEN 'Selection'
      ELSE 'SetControlGroup' END AS event,
    CAST(FLOOR(value) AS INT) AS xi, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events),
log AS (
  SELECT game_id, winner, seq, time, player, species, event, CAST(FLOOR(time) AS INT) AS slice,
    CASE event
      WHEN 'Camera' THEN 'at (' || xi || '.25, ' || k || '.5)'
      WHEN 'Right Click' THEN 'Location: (' || xi || '.0, ' || k || '.0, 10)'
      WHEN 'Ability' THEN '(' || k || ') - ' ||
        CASE k % 8 WHEN 0 THEN 'TrainMarine' WHEN 1 THEN 'BuildSiegeTank'
          WHEN 2 THEN 'WarpInZealot' WHEN 3 THEN 'MorphToLurker' WHEN 4 THEN 'UpgradeToMothership'
          WHEN 5 THEN 'ResearchStim' ELSE 'Attack' END
        || '; Location: (' || xi || '.0, ' || k || '.0, 10)'
      WHEN 'Selection' THEN
        CASE k % 5 WHEN 0 THEN 'Marine' WHEN 1 THEN 'Zealot' WHEN 2 THEN 'Zergling'
          WHEN 3 THEN 'SCV' ELSE 'SiegeTankSieged' END || ' [A' || (k % 7) || '], ' ||
        CASE xi % 4 WHEN 0 THEN 'Stalker' WHEN 1 THEN 'Roach' WHEN 2 THEN 'LurkerBurrowed'
          ELSE 'MineralField' END || ' [B' || (xi % 7) || ']'
    END AS event_contents
  FROM e)"""

_UNITS = "unit_info(unit, species, supply, minerals, gas) AS (VALUES " + ", ".join(
    f"('{u}', '{s}', {a}e0, {m}e0, {g}e0)" for u, s, a, m, g in UNITS.rows
) + ")"

_COORD = r"(?:Location:|at)\s\(([0-9]*)[.0-9]*,\s([0-9]*)[.0-9]*.*?\)"
_TARGET = (
    r"(?:Target:\s([A-Za-z]*)\s\[([0-9A-Z]*)\][\s;]*)?"
    r"Location:\s\(([0-9]*)[.0-9]*,\s([0-9]*)[.0-9]*.*?\)"
)
_MENTION = r"([0-9A-Za-z]*)\s\[([0-9A-Z]*)\]"


def _sql(*ctes: str, final: str) -> str:
    """A statement over the log view and further common table expressions."""
    return "WITH " + ",\n".join([_LOG.strip(), *[c.strip() for c in ctes]]) + "\n" + final.strip()


def _cases(pattern: str, cells: list[tuple], value: str, agg: str = "MAX") -> str:
    """One conditional aggregate per (player, minute)."""
    return ", ".join(
        f"{agg}(CASE WHEN player = {p} AND slice = {m} THEN {value} END) AS "
        + pattern.format(p=p, m=m)
        for p, m in cells
    )


_CELLS = [(p, m) for p in PLAYERS for m in range(10)]

# --- scans, parsers ---

ORACLE["scan_event_partition"] = _sql(
    final="""SELECT seq, game_id, player, species, ROUND(time, 6) AS time, event_contents
             FROM log WHERE event = 'Ability'"""
)
ORACLE["union_train_test"] = _sql(
    final=f"""SELECT seq, game_id, player, species, event, ROUND(time, 6) AS time FROM log
              WHERE game_id < {TRAIN_GAMES}
              UNION ALL
              SELECT seq + (SELECT greatest(max(seq) FILTER (game_id < {TRAIN_GAMES}) + 1
                - min(seq) FILTER (game_id >= {TRAIN_GAMES}), 0) FROM log),
              game_id, player, species, event, ROUND(time, 6) FROM log
              WHERE game_id >= {TRAIN_GAMES}"""
)
ORACLE["limit_scan"] = _sql(
    final="SELECT seq, game_id, player, event FROM log ORDER BY seq LIMIT 100"
)
ORACLE["ingested_csv"] = _sql(
    final="""SELECT * FROM (SELECT ROW_NUMBER() OVER (ORDER BY seq) - 1 AS seq, game_id, winner, player,
      species, event, event_contents FROM log) t WHERE event IN ('Camera', 'Ability')"""
)
ORACLE["parse_coordinates"] = _sql(
    final=rf"""
SELECT seq, event, slice, x, y, target, target_x, target_y FROM (
  SELECT seq, event, slice,
    TRY_CAST(regexp_extract(event_contents, '{_COORD}', 1) AS INT) AS x,
    TRY_CAST(regexp_extract(event_contents, '{_COORD}', 2) AS INT) AS y,
    NULLIF(regexp_extract(event_contents, '{_TARGET}', 1), '') AS target,
    TRY_CAST(regexp_extract(event_contents, '{_TARGET}', 3) AS INT) AS target_x,
    TRY_CAST(regexp_extract(event_contents, '{_TARGET}', 4) AS INT) AS target_y
  FROM log WHERE event IN ('Camera', 'Right Click', 'Ability')) t
WHERE x IS NOT NULL AND y IS NOT NULL"""
)

ORACLE["parse_targets"] = _sql(
    """
clicks AS (
  SELECT seq, event, slice, CASE WHEN seq % 3 = 0 THEN 'Target: ' ||
    CASE seq % 7 WHEN 0 THEN 'Lurker Den' WHEN 1 THEN '' WHEN 2 THEN 'SiegeTank' ELSE 'Zealot' END
    || ' [' || printf('%X', seq) || CASE WHEN seq % 5 = 0 THEN 'x' ELSE '' END || ']; ' || event_contents
    ELSE event_contents END AS event_contents
  FROM log WHERE event = 'Right Click')""",
    final=rf"""
SELECT seq, event, slice, TRY_CAST(regexp_extract(event_contents, '{_COORD}', 1) AS INT) AS x,
  TRY_CAST(regexp_extract(event_contents, '{_COORD}', 2) AS INT) AS y,
  regexp_extract(event_contents, '{_TARGET}', 1) AS target,
  TRY_CAST(regexp_extract(event_contents, '{_TARGET}', 3) AS INT) AS target_x,
  TRY_CAST(regexp_extract(event_contents, '{_TARGET}', 4) AS INT) AS target_y
FROM clicks WHERE regexp_extract(event_contents, '{_TARGET}', 1) <> ''""",
)

_NAME = "string_split(string_split(event_contents, ';')[1], '- ')[-1]"


def _flag(word: str) -> str:
    return f"CAST(contains({_NAME}, '{word}') AS INT)"


ORACLE["parse_ability"] = _sql(
    final=rf"""
SELECT seq, {_NAME} AS ability,
  CASE WHEN contains(event_contents, ';')
    THEN string_split(string_split(event_contents, ';')[-1], ': ')[-1] END AS location,
  CASE WHEN regexp_matches(event_contents, '(?:Build|Train|Morph|Spawn|UpgradeTo|TransformTo|WarpIn)')
    THEN regexp_extract(event_contents,
      '(?:Build|Train|Morph|Spawn|UpgradeTo|TransformTo|WarpIn)+([0-9A-Za-z]*)', 1) END AS produced,
  {_flag('Train')} AS is_train, {_flag('Warp')} AS is_warp, {_flag('Morph')} AS is_morph,
  {_flag('Build')} AS is_build, {_flag('Upgrade')} AS is_upgrade,
  {_flag('Research')} AS is_research, {_flag('Evlove')} AS is_evolve,
  {_flag('Attack')} AS is_attack
FROM log WHERE event = 'Ability'"""
)
ORACLE["ability_names"] = _sql(
    final="""SELECT DISTINCT species, string_split(event_contents, ';')[1] AS ability
             FROM log WHERE event = 'Ability'"""
)


def _produced(verb: str, pattern: str) -> str:
    text = f"array_to_string(regexp_extract_all(event_contents, '{pattern}'), ',')"
    for noise in (" ", "To", "GreaterSpire", "TransportOverlord", verb):
        text = f"replace({text}, '{noise}', '')"
    return text


_PRODUCED = "produced AS (SELECT *, " + " || ".join(
    [
        _produced("Train", "Train[A-Za-z]*"),
        _produced("Build", "BuildSiegeTank|BuildWidowMine|BuildHellion|BuildThor"),
        _produced("WarpIn", "WarpIn[A-Za-z]*"),
        _produced("WarpSelection", "[A-Za-z]*WarpSelection"),
        _produced("UpgradeTo", "UpgradeToMothership"),
        _produced("Morph", "Morph[A-Za-z]*"),
    ]
) + " AS unit FROM log WHERE event = 'Ability')"

ORACLE["parse_units_produced"] = _sql(
    _UNITS,
    _PRODUCED,
    final="""SELECT p.seq, p.species, p.unit, u.supply, u.minerals, u.gas
             FROM produced p LEFT JOIN unit_info u ON p.unit = u.unit AND p.species = u.species""",
)

_MENTIONS = rf"""
mention_lists AS (
  SELECT game_id, player, species, seq, regexp_extract_all(event_contents, '{_MENTION}', 1) AS names,
    regexp_extract_all(event_contents, '{_MENTION}', 2) AS ids
  FROM log WHERE event = 'Selection'),
mentions AS (
  SELECT * FROM (
    SELECT game_id, player, species, seq, CAST(i AS INT) - 1 AS pos,
      names[CAST(i AS INT)] AS name, ids[CAST(i AS INT)] AS unit_id
    FROM (SELECT *, unnest(range(1, len(names) + 1)) AS i FROM mention_lists) t) u
  WHERE name <> '')"""

_CLEAN = "replace(replace(name, 'Sieged', ''), 'Burrowed', '')"
_NO_WORKER = f"{_CLEAN} NOT IN ('SCV', 'Drone', 'Probe')"

ORACLE["parse_selection_units"] = _sql(
    _MENTIONS,
    final=f"""SELECT seq, pos, game_id, player, unit_id, {_CLEAN} AS unit
              FROM mentions WHERE {_NO_WORKER}""",
)

# --- ability features ---

ORACLE["game_duration"] = _sql(
    final="""SELECT game_id, ROUND(MAX(time) - MIN(time), 6) AS duration
             FROM log WHERE event = 'Ability' GROUP BY game_id"""
)

_SUMMARY = f"""
duration AS (
  SELECT game_id, MAX(time) - MIN(time) AS duration FROM log WHERE event = 'Ability'
  GROUP BY game_id),
summary AS (
  SELECT a.game_id, a.winner, d.duration, a.player, a.species,
    CAST(SUM({_flag('Train')} + {_flag('Warp')} + {_flag('Morph')}) AS BIGINT) AS train_sum,
    CAST(SUM({_flag('Build')}) AS BIGINT) AS build_sum,
    CAST(SUM({_flag('Upgrade')} + {_flag('Research')} + {_flag('Evlove')}) AS BIGINT)
      AS upgrade_sum,
    CAST(SUM({_flag('Attack')}) AS BIGINT) AS attack_sum
  FROM log a JOIN duration d ON a.game_id = d.game_id WHERE a.event = 'Ability'
  GROUP BY a.game_id, a.winner, d.duration, a.player, a.species)"""

ORACLE["ability_summary"] = _sql(
    _SUMMARY,
    final="""SELECT game_id, winner, ROUND(duration, 6) AS duration, player, species, train_sum,
             build_sum, upgrade_sum, attack_sum FROM summary""",
)

_COST = """
cost AS (
  SELECT p.game_id, p.player, COALESCE(SUM(u.supply), 0) AS supply,
    COALESCE(SUM(u.minerals), 0) AS minerals, COALESCE(SUM(u.gas), 0) AS gas
  FROM produced p LEFT JOIN unit_info u ON p.unit = u.unit AND p.species = u.species
  GROUP BY p.game_id, p.player)"""

ORACLE["production_cost"] = _sql(
    _UNITS,
    _PRODUCED,
    _COST,
    final="""SELECT game_id, player, ROUND(supply, 6) AS supply, ROUND(minerals, 6) AS minerals,
             ROUND(gas, 6) AS gas FROM cost""",
)

# --- start positions and maps ---

_CENTRES = "centres(starting, cx, cy) AS (VALUES " + ", ".join(
    f"({i}, {x}e0, {y}e0)" for i, (x, y) in enumerate(CENTRES, start=1)
) + ")"

_POSITIONS = """
cameras AS (
  SELECT game_id, player, event_contents,
    ROW_NUMBER() OVER (PARTITION BY game_id, player ORDER BY seq) AS nth
  FROM log WHERE event = 'Camera'),
first_camera AS (
  SELECT game_id, player,
    CAST(string_split(string_split(string_split(event_contents, '(')[2], ')')[1], ',')[1]
      AS DOUBLE) AS x,
    CAST(string_split(string_split(string_split(event_contents, '(')[2], ')')[1], ',')[2]
      AS DOUBLE) AS y
  FROM cameras WHERE nth = 1),
all_games AS (SELECT DISTINCT game_id FROM log),
positions AS (
  SELECT g.game_id, a.x AS player0_x, a.y AS player0_y, b.x AS player1_x, b.y AS player1_y
  FROM all_games g LEFT JOIN first_camera a ON g.game_id = a.game_id AND a.player = 0
  LEFT JOIN first_camera b ON g.game_id = b.game_id AND b.player = 1)"""

ORACLE["start_positions"] = _sql(
    _POSITIONS,
    final="""SELECT game_id, ROUND(player0_x, 6) AS player0_x, ROUND(player0_y, 6) AS player0_y,
             ROUND(player1_x, 6) AS player1_x, ROUND(player1_y, 6) AS player1_y FROM positions""",
)
ORACLE["start_points"] = _sql(
    _POSITIONS,
    final="""SELECT game_id, player, ROUND(x, 6) AS location_x, ROUND(y, 6) AS location_y
             FROM first_camera""",
)

_STARTS = f"""
measured AS (
  SELECT f.game_id, f.player, c.starting, sqrt((f.x - c.cx) * (f.x - c.cx)
    + (f.y - c.cy) * (f.y - c.cy)) AS distance
  FROM first_camera f CROSS JOIN centres c),
nearest AS (
  SELECT game_id, player, starting, distance,
    ROW_NUMBER() OVER (PARTITION BY game_id, player ORDER BY distance, starting) AS place
  FROM measured),
starts AS (
  SELECT game_id, player, CASE WHEN distance > {RADIUS} THEN 0 ELSE starting END AS starting
  FROM nearest WHERE place = 1),
games0 AS (
  SELECT g.game_id, COALESCE(a.starting, 0) AS p0, COALESCE(b.starting, 0) AS p1
  FROM all_games g LEFT JOIN starts a ON g.game_id = a.game_id AND a.player = 0
  LEFT JOIN starts b ON g.game_id = b.game_id AND b.player = 1)"""

ORACLE["unresolved_starts"] = _sql(
    _POSITIONS,
    _CENTRES,
    _STARTS,
    final="""SELECT game_id, CAST(p0 AS INT) AS player0_starting, CAST(p1 AS INT) AS player1_starting
             FROM games0 WHERE p0 = 0 OR p1 = 0""",
)


def _map_steps() -> str:
    """Maps, then for each map in turn the four updates, then the map numbers in turn."""
    ctes = [
        f"""
pairs AS (
  SELECT p0, p1, COUNT(*) AS n FROM games0 WHERE p0 > 0 GROUP BY p0, p1),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY p0 ORDER BY n DESC, p1) AS place FROM pairs),
triples AS (
  SELECT DISTINCT list_sort([f.p0, f.p1,
    CASE WHEN s.n >= {SUPPORT} THEN s.p1 ELSE 999 END]) AS m
  FROM ranked f LEFT JOIN ranked s ON f.p0 = s.p0 AND s.place = 2 WHERE f.place = 1),
maps AS (
  SELECT m[1] AS m0, m[2] AS m1, m[3] AS m2,
    ROW_NUMBER() OVER (ORDER BY m[1], m[2], m[3]) - 1 AS map FROM triples)"""
    ]
    current = "games0"
    steps = (
        ("p0", "p1", "m0", "m1"),
        ("p0", "p1", "m1", "m0"),
        ("p1", "p0", "m0", "m1"),
        ("p1", "p0", "m1", "m0"),
    )
    for i in range(len(CENTRES)):
        for j, (unknown, known, member, other) in enumerate(steps):
            name = f"step_{i}_{j}"
            kept = "p1" if unknown == "p0" else "p0"
            ctes.append(
                f"""{name} AS (SELECT g.game_id, CASE WHEN g.{unknown} = 0 AND
  (g.{known} = m.{member} OR g.{known} = m.m2) THEN m.{other} ELSE g.{unknown} END AS {unknown},
  g.{kept} FROM {current} g LEFT JOIN (SELECT * FROM maps WHERE map = {i}) m ON TRUE)"""
            )
            current = name
    ctes.append(
        f"""
map_data AS (
  SELECT g.game_id, CAST(g.p0 AS INT) AS player0_starting, CAST(g.p1 AS INT) AS player1_starting,
    CAST((SELECT MAX(m.map) FROM maps m WHERE g.p0 IN (m.m0, m.m1, m.m2)) AS INT) AS map
  FROM {current} g)"""
    )
    return ",\n".join(ctes)


_MAPS = (_POSITIONS, _CENTRES, _STARTS, _map_steps())

ORACLE["map_assignment"] = _sql(*_MAPS, final="SELECT * FROM map_data")

_KEY = "[player0_x, player0_y, player1_x, player1_y]"
ORACLE["unordered_start_key"] = _sql(
    _POSITIONS,
    final=f"""SELECT both_starting, COUNT(*) AS games FROM (
  SELECT array_to_string(list_transform(list_sort({_KEY}), lambda v: CAST(v AS VARCHAR)), ', ')
    AS both_starting
  FROM positions WHERE player0_x IS NOT NULL AND player1_x IS NOT NULL) t
GROUP BY both_starting""",
)

# --- one row per game ---

_SIDE = ("species", "train_sum", "build_sum", "upgrade_sum", "attack_sum", "supply", "minerals",
         "gas")
_FLAT = f"""
sides AS (
  SELECT s.*, c.supply, c.minerals, c.gas FROM summary s
  JOIN cost c ON s.game_id = c.game_id AND s.player = c.player),
flat AS (
  SELECT a.game_id, a.winner, a.duration,
    {", ".join(f"CAST(COALESCE(m.map = {i}, FALSE) AS INT) AS map_{i}" for i in range(7))},
    {", ".join(f"a.{v} AS {v}_0, b.{v} AS {v}_1" for v in _SIDE)}
  FROM sides a JOIN sides b ON a.game_id = b.game_id AND a.winner = b.winner
  LEFT JOIN map_data m ON a.game_id = m.game_id
  WHERE a.player = 0 AND b.player = 1)"""
_GAMES = (_UNITS, _PRODUCED, _SUMMARY, _COST, *_MAPS, _FLAT)

_SPECIES_FLAGS = ", ".join(
    f"CAST(COALESCE(species_{p} = '{s}', FALSE) AS INT) AS species{p}_{s}"
    for p in PLAYERS
    for s in SPECIES
)
_COSTS_ROUNDED = ", ".join(
    f"ROUND({c}_{p}, 6) AS {c}_{p}" for p in PLAYERS for c in ("supply", "minerals", "gas")
)
_COUNTS = ", ".join(
    f"{c}_sum_{p}" for p in PLAYERS for c in ("train", "build", "upgrade", "attack")
)
_MAP_FLAGS = ", ".join(f"map_{i}" for i in range(7))

ORACLE["player_flatten"] = _sql(
    *_GAMES,
    final=f"""SELECT game_id, winner, ROUND(duration, 6) AS duration, {_MAP_FLAGS}, {_COUNTS},
              {_COSTS_ROUNDED}, {_SPECIES_FLAGS} FROM flat""",
)
ORACLE["ratio_features"] = _sql(
    *_GAMES,
    final="SELECT game_id, "
    + ", ".join(
        f"ROUND({c}_0 / ({c}_0 + {c}_1 + 0.00000001e0), 6) AS {c.removesuffix('_sum')}_ratio"
        for c in _SIDE[1:]
    )
    + " FROM flat",
)


def _code(column: str) -> str:
    return f"CASE {column} WHEN 'T' THEN 1 WHEN 'P' THEN 2 WHEN 'Z' THEN 3 ELSE 0 END"


ORACLE["species_label_encode"] = _sql(
    *_GAMES,
    final=f"""SELECT game_id, {_code('species_0')} AS species_0, {_code('species_1')} AS species_1
              FROM flat""",
)
_MIX = f"CAST({_code('species_0')} AS VARCHAR) || CAST({_code('species_1')} AS VARCHAR)"
ORACLE["matchup_mix"] = _sql(
    *_GAMES, final=f"SELECT {_MIX} AS species_mix, COUNT(*) AS games FROM flat GROUP BY 1"
)
ORACLE["matchup_segment"] = _sql(
    *_GAMES,
    final=f"""SELECT * FROM (SELECT game_id, winner, {_MIX} AS species_mix FROM flat) t
              WHERE species_mix = '12'""",
)

ORACLE["exported_locations"] = _sql(
    """
located AS (
  SELECT CASE WHEN contains(event_contents, ';')
    THEN string_split(string_split(event_contents, ';')[-1], ': ')[-1] END AS location
  FROM log WHERE event = 'Ability')""",
    final="SELECT location, COUNT(*) AS n FROM located WHERE location IS NOT NULL GROUP BY location",
)
ORACLE["overwritten_table"] = ORACLE["game_duration"]

# --- actions ---

_AGILITY = f"""
acted AS (
  SELECT game_id, player, slice, COUNT(*) AS n FROM log
  WHERE event IN ('Ability', 'Right Click') AND slice < 10 GROUP BY game_id, player, slice),
agility AS (
  SELECT game_id, {", ".join(
      f"CAST(COALESCE(SUM(CASE WHEN player = {p} AND slice = {m} THEN n END), 0) AS BIGINT) "
      f"AS p{p}_actions_{m}" for p, m in _CELLS)}
  FROM acted GROUP BY game_id
  HAVING COUNT(CASE WHEN player = 0 THEN 1 END) > 0 AND COUNT(CASE WHEN player = 1 THEN 1 END) > 0)
"""
_AGILITY_TOTALS = ", ".join(
    " + ".join(f"p{p}_actions_{m}" for m in range(10)) + f" AS p{p}_actions" for p in PLAYERS
)
ORACLE["action_agility"] = _sql(_AGILITY, final=f"SELECT *, {_AGILITY_TOTALS} FROM agility")

_ATTACK = rf"""
supply_of AS (
  SELECT unit, supply FROM unit_info WHERE unit NOT IN ('SCV', 'Drone', 'Probe')),
picked AS (
  SELECT l.seq, SUM(s.supply) AS supply
  FROM (SELECT seq, unnest(regexp_extract_all(event_contents, '{_MENTION}', 1)) AS name FROM log
        WHERE event = 'Selection') l JOIN supply_of s ON l.name = s.unit
  GROUP BY l.seq),
kept AS (
  SELECT l.game_id, l.player, l.seq, l.slice, l.event, p.supply
  FROM log l LEFT JOIN picked p ON l.seq = p.seq
  WHERE l.slice < 12 AND (p.seq IS NOT NULL
    OR (l.event = 'Ability' AND contains(l.event_contents, 'Attack')))),
attacks AS (
  SELECT game_id, player, slice, before AS strength FROM (
    SELECT *, LAG(supply) OVER (PARTITION BY game_id, player ORDER BY seq) AS before FROM kept) t
  WHERE event = 'Ability' AND before IS NOT NULL),
attack AS (
  SELECT game_id, {", ".join(
      f"COALESCE(SUM(CASE WHEN player = {p} THEN strength END), 0) AS p{p}_attack_units"
      for p in PLAYERS)},
    {", ".join(
      f"COALESCE(SUM(CASE WHEN player = {p} AND slice = {s} THEN strength END), 0) "
      f"AS attack_units_p{p}_s{s}" for p in PLAYERS for s in range(5, 12))}
  FROM attacks GROUP BY game_id)"""
ORACLE["attack_strength"] = _sql(_UNITS, _ATTACK, final="SELECT * FROM attack")


def _event_columns() -> str:
    return ", ".join(
        f"COUNT(CASE WHEN player = {p} AND event = '{e}' THEN 1 END) "
        f"AS \"{p}_{e.replace(' ', '_')}\""
        for p in PLAYERS
        for e in EVENTS
    )


def _chunked(condition: str, name: str) -> str:
    """``_AGILITY`` of some rows under another name."""
    return _AGILITY.replace("acted", f"acted_{name}").replace("agility AS", f"{name} AS").replace(
        "event IN ('Ability', 'Right Click')", condition
    )


ORACLE["rewritten_chunk"] = _sql(
    _chunked("event = 'Ability'", "stale"),
    _chunked("event IN ('Ability', 'Right Click') AND game_id BETWEEN 100 AND 199", "fresh"),
    final="""SELECT * FROM stale WHERE game_id NOT BETWEEN 100 AND 199
UNION ALL SELECT * FROM fresh""",
)
ORACLE["player_event_counts"] = _sql(
    final=f"SELECT game_id, {_event_columns()} FROM log GROUP BY game_id"
)
_LABELS = """
labels_of AS (
  SELECT game_id, MAX(CASE WHEN player = 0 THEN species END) AS species_0,
    MAX(CASE WHEN player = 1 THEN species END) AS species_1, MAX(winner) AS winner
  FROM (SELECT DISTINCT game_id, winner, player, species FROM log) t GROUP BY game_id)"""
ORACLE["species_labels"] = _sql(
    _LABELS, final="SELECT game_id, species_0, species_1, winner FROM labels_of"
)
ORACLE["baseline_set"] = _sql(
    _LABELS,
    f"counts AS (SELECT game_id, {_event_columns()} FROM log GROUP BY game_id)",
    final=f"""SELECT l.game_id, l.winner, {_SPECIES_FLAGS}, c.* EXCLUDE (game_id)
              FROM labels_of l JOIN counts c ON l.game_id = c.game_id""",
)

# --- camera ---

_POINTS = rf"""
points AS (
  SELECT * FROM (
    SELECT game_id, player, seq, slice,
      TRY_CAST(regexp_extract(event_contents, '{_COORD}', 1) AS INT) AS x,
      TRY_CAST(regexp_extract(event_contents, '{_COORD}', 2) AS INT) AS y
    FROM log WHERE event IN ('Camera', 'Right Click')) t
  WHERE x IS NOT NULL AND y IS NOT NULL)"""

_DRIFT = f"""
early AS (SELECT * FROM points WHERE slice < 10),
first_early AS (
  SELECT game_id, player, x AS bx, y AS by FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, player ORDER BY seq) AS nth FROM early) t
  WHERE nth = 1),
drifted AS (
  SELECT e.game_id, e.player, e.slice,
    sqrt(pow(AVG(e.x) - MIN(f.bx), 2) + pow(AVG(e.y) - MIN(f.by), 2)) AS dist
  FROM early e JOIN first_early f ON e.game_id = f.game_id AND e.player = f.player
  GROUP BY e.game_id, e.player, e.slice),
drift AS (
  SELECT game_id, {", ".join(
      f"COALESCE(MAX(CASE WHEN player = {p} AND slice = {m} THEN dist END), 0) AS p{p}_center_{m}"
      for p, m in _CELLS)}
  FROM drifted GROUP BY game_id
  HAVING COUNT(CASE WHEN player = 0 THEN 1 END) > 0 AND COUNT(CASE WHEN player = 1 THEN 1 END) > 0)
"""


def _rounded(names: list[str]) -> str:
    return ", ".join(f"ROUND({n}, 6) AS {n}" for n in names)


ORACLE["camera_center_drift"] = _sql(
    _POINTS,
    _DRIFT,
    final=f"SELECT game_id, {_rounded([f'p{p}_center_{m}' for p, m in _CELLS])} FROM drift",
)

ORACLE["event_table_drift"] = ORACLE["camera_center_drift"]

_STEP_NAMES = [f"p{p}_moving_{s}" for s in ("mean", "std") for p in PLAYERS] + [
    f"cam_moving_p{p}_{s}{m}" for p, m in _CELLS for s in ("mean", "std")
]
_STEPS = f"""
stepped AS (
  SELECT game_id, player, slice, sqrt(pow(px - x, 2) + pow(py - y, 2)) AS dist FROM (
    SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py FROM points WHERE slice < 10
    WINDOW w AS (PARTITION BY game_id, player ORDER BY seq)) t
  WHERE px IS NOT NULL),
step_stats AS (
  SELECT game_id, {", ".join(
      f"{f}(CASE WHEN player = {p} THEN dist END) AS p{p}_moving_{s}"
      for s, f in (("mean", "AVG"), ("std", "STDDEV_SAMP")) for p in PLAYERS)},
    {_cases("cam_moving_p{p}_mean{m}", _CELLS, "dist", "AVG")},
    {_cases("cam_moving_p{p}_std{m}", _CELLS, "dist", "STDDEV_SAMP")}
  FROM stepped GROUP BY game_id)"""
ORACLE["camera_step_stats"] = _sql(
    _POINTS, _STEPS, final=f"SELECT game_id, {_rounded(_STEP_NAMES)} FROM step_stats"
)

_SIDED = f"""
first_point AS (
  SELECT game_id, player, x, y FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, player ORDER BY seq) AS nth FROM points) t
  WHERE nth = 1),
sided AS (
  SELECT p.game_id, p.player, p.slice, p.seq,
    CASE WHEN p.player = 0 THEN
      sqrt(pow(p.x - a.x, 2) + pow(p.y - a.y, 2)) > sqrt(pow(p.x - b.x, 2) + pow(p.y - b.y, 2))
    ELSE
      sqrt(pow(p.x - b.x, 2) + pow(p.y - b.y, 2)) > sqrt(pow(p.x - a.x, 2) + pow(p.y - a.y, 2))
    END AS aggressive,
    ROW_NUMBER() OVER (PARTITION BY p.game_id ORDER BY p.seq DESC) <= {LAST_ROWS} AS is_last
  FROM points p JOIN first_point a ON p.game_id = a.game_id AND a.player = 0
  JOIN first_point b ON p.game_id = b.game_id AND b.player = 1)"""


def _n(condition: str) -> str:
    return f"CAST(COUNT(CASE WHEN {condition} THEN 1 END) AS DOUBLE)"


def _ratio(a: str, b: str) -> str:
    return (
        f"CASE WHEN {b} <> 0 THEN {a} / {b} "
        f"WHEN {a} > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0 END"
    )


_HOMEAWAY = f"""
tallies AS (
  SELECT game_id, {", ".join(
      f"{_n(f'player = {p}')} AS all{p}, {_n(f'player = {p} AND aggressive')} AS away{p}, "
      f"{_n(f'player = {p} AND NOT aggressive')} AS home{p}, "
      f"{_n(f'player = {p} AND is_last')} AS all_last{p}, "
      f"{_n(f'player = {p} AND is_last AND aggressive')} AS away_last{p}" for p in PLAYERS)}
  FROM sided GROUP BY game_id),
homeaway AS (
  SELECT game_id,
    {_ratio("away0", "all0")} AS cam_remote_ratio0, {_ratio("away1", "all1")} AS cam_remote_ratio1,
    {_ratio("away_last0", "all_last0")} AS cam_remote_ratio0_last,
    {_ratio("away_last1", "all_last1")} AS cam_remote_ratio1_last,
    home1 AS camera_home_p0, home0 AS camera_home_p1,
    away1 AS camera_enemy_to_p0, away0 AS camera_enemy_to_p1,
    {_ratio("away1", "home1")} AS homeaway_p0, {_ratio("away0", "home0")} AS homeaway_p1
  FROM tallies WHERE away0 + away1 > 0 AND home0 + home1 > 0)"""
_HOMEAWAY_NAMES = [
    f"cam_remote_ratio{p}{s}" for p in PLAYERS for s in ("", "_last")
] + [f"{n}_p{p}" for n in ("camera_home", "camera_enemy_to", "homeaway") for p in PLAYERS]
ORACLE["camera_home_away"] = _sql(
    _POINTS, _SIDED, _HOMEAWAY, final=f"SELECT game_id, {_rounded(_HOMEAWAY_NAMES)} FROM homeaway"
)
ORACLE["last_minutes_pressure"] = _sql(
    _POINTS,
    _SIDED,
    final="""SELECT game_id, player, COUNT(CASE WHEN aggressive THEN 1 END) AS pressure,
  MIN(slice) AS from_slice
FROM (SELECT *, DENSE_RANK() OVER (PARTITION BY game_id, player ORDER BY slice DESC) AS back
      FROM sided) t
WHERE back <= 3 GROUP BY game_id, player""",
)
ORACLE["aggressive_per_minute"] = _sql(
    _POINTS,
    _SIDED,
    final="""SELECT game_id, player, slice, COUNT(*) AS rows_in_slice,
             COUNT(CASE WHEN aggressive THEN 1 END) AS aggressive_rows
             FROM sided GROUP BY game_id, player, slice""",
)

# --- units ---

_OWNED = f"""
claimed AS (
  SELECT m.game_id, m.unit_id, m.player, m.seq, m.pos, {_CLEAN} AS unit,
    EXISTS (SELECT 1 FROM unit_info u WHERE u.unit = {_CLEAN} AND u.species = m.species) AS native
  FROM mentions m
  WHERE {_NO_WORKER} AND {_CLEAN} IN (SELECT unit FROM unit_info)),
ordered_claims AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, unit_id ORDER BY seq, pos) AS nth FROM claimed),
owners AS (
  SELECT game_id, unit_id, CASE WHEN native THEN player ELSE 1 - player END AS owner,
    unit AS first_unit
  FROM ordered_claims WHERE nth = 1),
lost AS (
  SELECT c.game_id, c.unit_id, MIN(c.nth) AS lost_at
  FROM ordered_claims c JOIN owners o ON c.game_id = o.game_id AND c.unit_id = o.unit_id
  WHERE c.player = o.owner AND NOT c.native AND c.nth > 1 GROUP BY c.game_id, c.unit_id),
renamed AS (
  SELECT c.game_id, c.unit_id, MAX(c.nth) AS last_at
  FROM ordered_claims c JOIN owners o ON c.game_id = o.game_id AND c.unit_id = o.unit_id
  LEFT JOIN lost l ON c.game_id = l.game_id AND c.unit_id = l.unit_id
  WHERE c.player = o.owner AND c.native AND (l.lost_at IS NULL OR c.nth < l.lost_at)
  GROUP BY c.game_id, c.unit_id),
owned AS (
  SELECT o.game_id, o.owner AS player, o.unit_id, COALESCE(c.unit, o.first_unit) AS unit
  FROM owners o LEFT JOIN renamed r ON o.game_id = r.game_id AND o.unit_id = r.unit_id
  LEFT JOIN ordered_claims c ON c.game_id = r.game_id AND c.unit_id = r.unit_id AND c.nth = r.last_at
  UNION ALL
  SELECT o.game_id, 1 - o.owner, o.unit_id, c.unit
  FROM owners o JOIN lost l ON o.game_id = l.game_id AND o.unit_id = l.unit_id
  JOIN ordered_claims c ON c.game_id = l.game_id AND c.unit_id = l.unit_id AND c.nth = l.lost_at)"""
ORACLE["unit_ownership"] = _sql(
    _UNITS, _MENTIONS, _OWNED, final="SELECT game_id, player, unit_id, unit FROM owned"
)
_DENSE = f"""
grid AS (
  SELECT CAST(unnest(range(0, (SELECT MAX(game_id) + 1 FROM log WHERE event = 'Selection'))) AS INT)
    AS game_id),
unit_counts AS (
  SELECT g.game_id, {", ".join(
      f"COUNT(CASE WHEN o.player = {p} AND o.unit = '{u}' THEN 1 END) AS p{p}_{u}"
      for p in PLAYERS for u in UNITS.units)}
  FROM grid g LEFT JOIN owned o ON g.game_id = o.game_id GROUP BY g.game_id)"""
ORACLE["unit_counts_dense"] = _sql(
    _UNITS, _MENTIONS, _OWNED, _DENSE, final="SELECT * FROM unit_counts"
)
ORACLE["native_units"] = _sql(
    _UNITS,
    _MENTIONS,
    final="""SELECT u.species, u.unit AS name, COUNT(m.name) AS mentions
             FROM unit_info u LEFT JOIN mentions m ON m.species = u.species AND m.name = u.unit
             GROUP BY u.species, u.unit""",
)

_FIRST_CLAIMS = """
mention_order AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, unit_id ORDER BY seq, pos) AS nth FROM mentions),
accepted AS (
  SELECT m.*, ROW_NUMBER() OVER (PARTITION BY m.game_id, m.unit_id ORDER BY m.nth DESC) AS back
  FROM mention_order m JOIN mention_order f
    ON m.game_id = f.game_id AND m.unit_id = f.unit_id AND f.nth = 1 AND f.player = m.player),
frequency AS (
  SELECT species, name, COUNT(*) AS mentions FROM accepted GROUP BY species, name),
places AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY species ORDER BY mentions DESC, name) AS place
  FROM frequency),
held AS (SELECT game_id, player, unit_id, name FROM accepted WHERE back = 1)"""
ORACLE["unit_name_frequency"] = _sql(
    _MENTIONS, _FIRST_CLAIMS, final="SELECT species, name, mentions FROM frequency"
)
ORACLE["rare_units"] = _sql(
    _MENTIONS,
    _FIRST_CLAIMS,
    final=f"SELECT species, name, mentions FROM places WHERE place > {RARE_AFTER}",
)
_SLOTS = f"""
species_of AS (
  SELECT game_id, player, species FROM (
    SELECT game_id, player, species,
      ROW_NUMBER() OVER (PARTITION BY game_id, player ORDER BY seq) AS nth
    FROM log WHERE event = 'Selection') t WHERE nth = 1),
slots AS (
  SELECT g.game_id, {", ".join(
      f"COUNT(CASE WHEN h.player = {p} AND r.place = {i + 1} THEN 1 END) AS p{p}_u{i}"
      for p in PLAYERS for i in range(TOP))}
  FROM (SELECT DISTINCT game_id FROM log WHERE event = 'Selection') g
  LEFT JOIN held h ON g.game_id = h.game_id
  LEFT JOIN species_of s ON h.game_id = s.game_id AND h.player = s.player
  LEFT JOIN places r ON r.name = h.name AND r.species = COALESCE(s.species, 'T')
    AND r.place <= {TOP}
  GROUP BY g.game_id)"""
ORACLE["top_unit_slots"] = _sql(
    _MENTIONS, _FIRST_CLAIMS, _SLOTS, final="SELECT * FROM slots"
)
ORACLE["slot_ratios"] = _sql(
    _MENTIONS,
    _FIRST_CLAIMS,
    _SLOTS,
    final="SELECT game_id, "
    + ", ".join(
        f"ROUND(p0_u{i} / (p0_u{i} + p1_u{i} + 0.00000001e0), 6) AS u{i}_ratio" for i in range(TOP)
    )
    + " FROM slots",
)
ORACLE["neutral_units"] = _sql(
    _MENTIONS,
    _FIRST_CLAIMS,
    """
neutral AS (
  SELECT name FROM frequency WHERE species = 'T' INTERSECT
  SELECT name FROM frequency WHERE species = 'P' INTERSECT
  SELECT name FROM frequency WHERE species = 'Z'),
taken AS (
  SELECT a.game_id, a.unit_id, MIN(a.seq) AS seq, MIN_BY(a.pos, a.seq * 1000 + a.pos) AS pos
  FROM accepted a GROUP BY a.game_id, a.unit_id),
queue AS (
  SELECT h.*, ROW_NUMBER() OVER (PARTITION BY h.game_id, h.player, h.name
    ORDER BY t.seq DESC, t.pos DESC) AS back
  FROM held h JOIN taken t ON h.game_id = t.game_id AND h.unit_id = t.unit_id)""",
    final="""SELECT game_id, player, unit_id, name FROM queue
             WHERE NOT (back = 1 AND name IN (SELECT name FROM neutral))""",
)
ORACLE["roster_side_by_side"] = _sql(
    _UNITS,
    _MENTIONS,
    _OWNED,
    """
seats AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, player ORDER BY unit_id) AS position
  FROM owned),
seat_rows AS (
  SELECT COALESCE(a.game_id, b.game_id) AS game_id, COALESCE(a.position, b.position) AS position,
    a.unit AS unit_0, b.unit AS unit_1
  FROM (SELECT * FROM seats WHERE player = 0) a
  FULL JOIN (SELECT * FROM seats WHERE player = 1) b
    ON a.game_id = b.game_id AND a.position = b.position),
firsts AS (
  SELECT game_id, player, species, winner FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY game_id, player ORDER BY seq) AS nth FROM log) t
  WHERE nth = 1)""",
    final="""SELECT s.game_id, s.position, s.unit_0, s.unit_1,
  a.species || CASE WHEN a.winner = 0 THEN ' (True)' ELSE ' (False)' END AS head_0,
  b.species || CASE WHEN b.winner = 1 THEN ' (True)' ELSE ' (False)' END AS head_1
FROM seat_rows s LEFT JOIN firsts a ON s.game_id = a.game_id AND a.player = 0
LEFT JOIN firsts b ON s.game_id = b.game_id AND b.player = 1""",
)

# --- exploration ---

ORACLE["late_start_games"] = _sql(
    final="""SELECT game_id, ROUND(MIN(time), 6) AS first_time FROM log WHERE event = 'Ability'
             GROUP BY game_id"""
)
ORACLE["start_time_frequency"] = _sql(
    final="""SELECT ROUND(first_time, 1) AS first_time, COUNT(*) AS games
             FROM (SELECT MIN(time) AS first_time FROM log GROUP BY game_id) t GROUP BY 1"""
)
ORACLE["opening_rows"] = _sql(
    final="""SELECT game_id, ROUND(MIN(time), 6) AS first_time,
  COUNT(CASE WHEN event = 'Camera' AND time = 0 THEN 1 END) AS at_zero,
  COUNT(CASE WHEN event = 'Camera' THEN 1 END) AS cameras
FROM log GROUP BY game_id HAVING MIN(time) BETWEEN 0.5 AND 30.0"""
)
ORACLE["latest_game_timeline"] = _sql(
    final="""SELECT game_id, seq, ROUND(time, 6) AS time, player, event FROM log
WHERE game_id = (SELECT game_id FROM log GROUP BY game_id ORDER BY MIN(log.time) DESC, game_id LIMIT 1)"""
)
ORACLE["game_chunks"] = _sql(
    final="""SELECT CAST(FLOOR(game_id / 100) AS BIGINT) AS chunk, COUNT(DISTINCT game_id) AS games,
             COUNT(*) AS n_rows FROM log GROUP BY 1"""
)
ORACLE["distinct_and_range"] = _sql(
    final="""SELECT COUNT(*) AS n_rows, MIN(game_id) AS min_game, MAX(game_id) AS max_game,
             COUNT(DISTINCT game_id) AS n_games, COUNT(DISTINCT event) AS n_events FROM log"""
)
ORACLE["event_frequency"] = _sql(final="SELECT event, COUNT(*) AS n FROM log GROUP BY event")
ORACLE["summary_stats"] = _sql(
    final="\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", COUNT({c}) AS n, ROUND(AVG({c}), 6) AS mean,
  ROUND(STDDEV_SAMP({c}), 6) AS std, ROUND(CAST(MIN({c}) AS DOUBLE), 6) AS min,
  ROUND(CAST(MAX({c}) AS DOUBLE), 6) AS max FROM log"""
        for c in ("game_id", "winner", "time", "player")
    )
)
ORACLE["text_search_first"] = _sql(
    final="""SELECT seq, game_id, ROUND(time, 6) AS time, event_contents FROM log
             WHERE contains(event_contents, 'Mothership') ORDER BY log.time, seq LIMIT 20"""
)

# --- final matrix ---

_MATRIX_TABLES = (
    *_GAMES,
    _MENTIONS,
    _OWNED,
    _DENSE,
    _AGILITY,
    _ATTACK,
    _POINTS,
    _DRIFT,
    _STEPS,
    _SIDED,
    _HOMEAWAY,
)
_DROPPED = set(minute_columns())


def _zeroed(alias: str, names: list[str], digits: bool = False) -> str:
    def one(n: str) -> str:
        value = f"COALESCE({alias}.{n}, 0)"
        return f"ROUND({value}, 6) AS {n}" if digits else f"{value} AS {n}"

    return ", ".join(one(n) for n in names if n not in _DROPPED)


_WHOLE = [f"map_{i}" for i in range(7)] + [
    f"{c}_sum_{p}" for p in PLAYERS for c in ("train", "build", "upgrade", "attack")
]
_DECIMAL = ["duration"] + [f"{c}_{p}" for p in PLAYERS for c in ("supply", "minerals", "gas")]
_FLAGS = [f"species{p}_{s}" for p in PLAYERS for s in SPECIES]

ORACLE["kept_ownership"] = _sql(
    _UNITS,
    _MENTIONS,
    _OWNED,
    final="SELECT player, unit, COUNT(*) AS n, COUNT(DISTINCT game_id) AS games FROM owned GROUP BY player, unit",
)
ORACLE["final_matrix"] = _sql(
    *_MATRIX_TABLES,
    f"flags AS (SELECT game_id, {_SPECIES_FLAGS} FROM flat)",
    f"action_totals AS (SELECT game_id, {_AGILITY_TOTALS} FROM agility)",
    final=f"""
SELECT g.game_id, g.winner, {_zeroed("f", _WHOLE)}, {_zeroed("f", _DECIMAL, True)},
  {_zeroed("s", _FLAGS)}, {_zeroed("h", _HOMEAWAY_NAMES, True)},
  {_zeroed("t", [n for n in _STEP_NAMES if n.startswith("p")], True)},
  {_zeroed("a", [f"p{p}_attack_units" for p in PLAYERS], True)},
  {_zeroed("n", [f"p{p}_actions" for p in PLAYERS])}
FROM (SELECT game_id, MAX(winner) AS winner FROM log GROUP BY game_id) g
LEFT JOIN flat f ON g.game_id = f.game_id
LEFT JOIN flags s ON g.game_id = s.game_id LEFT JOIN homeaway h ON g.game_id = h.game_id
LEFT JOIN drift d ON g.game_id = d.game_id LEFT JOIN step_stats t ON g.game_id = t.game_id
LEFT JOIN attack a ON g.game_id = a.game_id LEFT JOIN action_totals n ON g.game_id = n.game_id
WHERE g.winner IS NOT NULL""",
)
ORACLE["saved_feature_matrix"] = ORACLE["final_matrix"]

# --- scores ---

_SCORED = """
scored AS (
  SELECT game_id, label, ROUND(CAST(mine AS DOUBLE) / total, 3) AS score FROM (
    SELECT game_id, MAX(winner) AS label,
      COUNT(CASE WHEN event IN ('Ability', 'Right Click') AND player = 1 THEN 1 END) AS mine,
      COUNT(CASE WHEN event IN ('Ability', 'Right Click') THEN 1 END) AS total
    FROM log GROUP BY game_id) t WHERE total > 0)"""

ORACLE["prediction_spine"] = _sql(
    _SCORED,
    final="""SELECT g.game_id, COALESCE(s.score, 0.5) AS winner
FROM (SELECT DISTINCT game_id FROM log) g
LEFT JOIN (SELECT * FROM scored WHERE ABS(score - 0.5) > 0.05) s ON g.game_id = s.game_id""",
)


def _digest(seed: int) -> str:
    digest = f"md5('{seed}:' || CAST(game_id AS VARCHAR))"
    return f"(CAST('0x' || substr({digest}, 1, 8) AS BIGINT) % 100)"


ORACLE["stable_split"] = _sql(
    final=f"""SELECT game_id, CASE WHEN {_digest(1)} < 20 THEN 'test'
  WHEN {_digest(2)} < 40 THEN 'valid' ELSE 'train' END AS part
FROM (SELECT DISTINCT game_id FROM log) t"""
)
ORACLE["kfold_ids"] = _sql(
    final="""SELECT game_id, CAST(NTILE(5) OVER (ORDER BY game_id) - 1 AS INT) AS fold
             FROM (SELECT DISTINCT game_id FROM log) t"""
)
ORACLE["auc_exact"] = _sql(
    _SCORED,
    final="""
SELECT ROUND((SELECT SUM(CASE WHEN p.score > n.score THEN 1.0e0
                              WHEN p.score = n.score THEN 0.5e0 ELSE 0.0e0 END)
  FROM scored p JOIN scored n ON p.label = 1 AND n.label = 0)
  / (COUNT(CASE WHEN label = 1 THEN 1 END) * COUNT(CASE WHEN label = 0 THEN 1 END)), 6) AS auc,
  COUNT(CASE WHEN label = 1 THEN 1 END) AS pos, COUNT(CASE WHEN label = 0 THEN 1 END) AS neg
FROM scored""",
)
_CURVE = """
games AS (SELECT game_id, MAX(winner) AS label, NTILE(5) OVER (ORDER BY game_id) - 1 AS fold
  FROM log GROUP BY game_id),
margins AS (
  SELECT g.game_id, label, fold, r AS round, COALESCE((SELECT SUM(CASE WHEN player = 1 THEN 1 ELSE -1 END)
    FROM log l WHERE l.game_id = g.game_id AND l.slice < r), 0) AS margin
  FROM games g, generate_series(1, 10) s(r)),
curve AS (
  SELECT fold, round, (SELECT SUM(CASE WHEN p.margin > n.margin THEN 1.0e0
      WHEN p.margin = n.margin THEN 0.5e0 ELSE 0.0e0 END) FROM margins p JOIN margins n
      ON p.label = 1 AND n.label = 0 AND p.fold = m.fold AND n.fold = m.fold AND p.round = m.round
      AND n.round = m.round) / (COUNT(*) FILTER (label = 1) * COUNT(*) FILTER (label = 0)) AS auc,
    COUNT(*) FILTER (label = 1) AS pos, COUNT(*) FILTER (label = 0) AS neg
  FROM margins m GROUP BY fold, round)"""
_ROUNDS = """
rounds AS (SELECT round, COUNT(*) AS folds, AVG(auc) AS mean_auc, STDDEV_SAMP(auc) AS std_auc
  FROM curve GROUP BY round)"""
ORACLE["fold_round_auc"] = _sql(
    _CURVE,
    final="SELECT CAST(fold AS INT) AS fold, CAST(round AS INT) AS round, ROUND(auc, 6) AS auc, pos, neg FROM curve",
)
ORACLE["margin_learning_curve"] = _sql(
    _CURVE,
    _ROUNDS,
    final="""
SELECT CAST(round AS INT) AS round, folds, ROUND(mean_auc, 6) AS mean_auc, ROUND(std_auc, 6) AS std_auc,
  round = (SELECT round FROM rounds ORDER BY ROUND(mean_auc, 12) DESC, round LIMIT 1) AS is_best
FROM rounds""",
)
ORACLE["best_margin_round"] = _sql(
    _CURVE,
    _ROUNDS,
    final="""
SELECT CAST((SELECT round FROM rounds ORDER BY ROUND(mean_auc, 12) DESC, round LIMIT 1) AS INT) AS best_round,
  ROUND(MAX(mean_auc), 6) AS best_metric,
  CAST((SELECT round FROM rounds ORDER BY ROUND(mean_auc, 12), round LIMIT 1) AS INT) AS worst_round,
  ROUND(MIN(mean_auc), 6) AS worst_metric
FROM rounds""",
)
ORACLE["auc_any_score"] = _sql(
    _LABELS,
    _SCORED,
    f"""
lead AS (SELECT {_MIX} AS species_mix, s.label, POW(s.score * 1000 - 500, 9) * 1e-280 AS score
  FROM scored s JOIN labels_of l ON s.game_id = l.game_id)""",
    final="""
SELECT species_mix, ROUND((SELECT SUM(CASE WHEN p.score > n.score THEN 1.0e0
      WHEN p.score = n.score THEN 0.5e0 ELSE 0.0e0 END) FROM lead p JOIN lead n
      ON p.label = 1 AND n.label = 0 AND p.species_mix = m.species_mix AND n.species_mix = m.species_mix)
    / NULLIF(COUNT(*) FILTER (label = 1) * COUNT(*) FILTER (label = 0), 0), 6) AS auc,
  COUNT(*) FILTER (label = 1) AS pos, COUNT(*) FILTER (label = 0) AS neg
FROM lead m GROUP BY species_mix""",
)
ORACLE["accuracy_f1"] = _sql(
    _SCORED,
    final="""
SELECT COUNT(*) AS n, ROUND(AVG(CASE WHEN (score > 0.5) = (label = 1) THEN 1.0e0 ELSE 0.0e0 END), 6)
    AS accuracy,
  ROUND(2.0e0 * COUNT(CASE WHEN score > 0.5 AND label = 1 THEN 1 END)
    / (COUNT(CASE WHEN score > 0.5 THEN 1 END) + COUNT(CASE WHEN label = 1 THEN 1 END)), 6) AS f1
FROM scored""",
)
ORACLE["error_analysis"] = _sql(
    *_MAPS,
    _LABELS,
    _SCORED,
    final=f"""
SELECT {_MIX} AS species_mix, m.map, COUNT(*) AS wrong
FROM labels_of l JOIN map_data m ON l.game_id = m.game_id
JOIN scored s ON l.game_id = s.game_id AND ABS(s.label - s.score) > 0.5
GROUP BY 1, 2""",
)
ORACLE["score_histogram"] = _sql(
    _SCORED,
    final="""
SELECT CAST(LEAST(FLOOR((score - low) / ((high - low) / 10)), 9) AS INT) AS bin, COUNT(*) AS n
FROM scored CROSS JOIN (SELECT MIN(score) AS low, MAX(score) AS high FROM scored) r GROUP BY 1""",
)
ORACLE["best_iteration"] = _sql(
    """
per_minute AS (
  SELECT game_id, player, slice, COUNT(*) AS actions FROM log GROUP BY game_id, player, slice),
running AS (
  SELECT *, SUM(actions) OVER (PARTITION BY game_id, player ORDER BY slice) AS so_far
  FROM per_minute),
rates AS (
  SELECT a.slice, ROUND(AVG(CASE WHEN CAST(b.so_far > a.so_far AS INT) = w.winner
    THEN 1.0e0 ELSE 0.0e0 END), 6) AS hit_rate
  FROM running a JOIN running b ON a.game_id = b.game_id AND a.slice = b.slice
  JOIN (SELECT game_id, MAX(winner) AS winner FROM log GROUP BY game_id) w ON a.game_id = w.game_id
  WHERE a.player = 0 AND b.player = 1 GROUP BY a.slice)""",
    final="""
SELECT (SELECT slice FROM rates ORDER BY hit_rate DESC, slice LIMIT 1) AS best_round,
  MAX(hit_rate) AS best_metric,
  (SELECT slice FROM rates ORDER BY hit_rate, slice LIMIT 1) AS worst_round,
  MIN(hit_rate) AS worst_metric
FROM rates""",
)
