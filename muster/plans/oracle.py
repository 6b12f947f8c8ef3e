"""DuckDB SQL for the queries, written from the rules and not from the Spark plans."""

from __future__ import annotations

_BASE = """
WITH o AS (
    SELECT *, o_orderkey // 18 AS mn, o_orderkey % 18 AS slot, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
           CAST(1 + (((o_orderkey % 18) * 5 + o_orderkey // 18) % 18) // 3 AS INTEGER) AS subteam_id
    FROM orders),
matches AS (
    SELECT 'M_' || lpad(CAST(mn AS VARCHAR), 6, '0') AS match_id, mn, min(o_orderdate) AS game_creation,
           ['16.8', '16.9', '16.18', '16.19'][1 + CAST((mn * 4) // (1 + (SELECT max(mn) FROM o)) AS INTEGER)] AS patch, count(*) = 18 AS ingested
    FROM o GROUP BY mn),
teams AS (
    SELECT mn, subteam_id, CAST(row_number() OVER (PARTITION BY mn ORDER BY sum(cents) DESC, subteam_id) AS INTEGER) AS placement
    FROM o GROUP BY mn, subteam_id),
held AS (SELECT l_orderkey, list(DISTINCT CAST(1000 + l_partkey % 60 AS INTEGER)) AS items FROM lineitem GROUP BY 1),
bought AS (
    SELECT l_orderkey, list(item ORDER BY first, item) AS item_order FROM (
        SELECT l_orderkey, CAST(CASE WHEN l_partkey % 60 >= 56 THEN 980 ELSE 1000 END + l_partkey % 60 AS INTEGER) AS item, min(l_shipdate) AS first
        FROM lineitem WHERE l_partkey % 60 NOT BETWEEN 4 AND 18 GROUP BY 1, 2) GROUP BY 1),
picked AS (
    SELECT l_orderkey, list(a ORDER BY first, a)[1:6] AS augments FROM (
        SELECT l_orderkey, CAST(1 + l_suppkey % 30 AS INTEGER) AS a, min(l_linenumber * 1000 + l_suppkey % 1000) AS first FROM lineitem GROUP BY 1, 2) GROUP BY 1),
part AS (
    SELECT m.match_id, m.patch, m.game_creation, CAST(o.slot * 20 + o.o_custkey % 20 AS INTEGER) AS player_id, o.subteam_id, t.placement,
           'C' || lpad(CAST((o.o_custkey + 7 * (o.o_orderkey % 11)) % 48 AS VARCHAR), 2, '0') AS champion,
           list_concat(list_sort(coalesce(h.items, [])), CASE WHEN o.o_orderkey % 211 = 0 THEN [220008] ELSE [] END) AS items,
           CASE WHEN o.o_orderkey % 5 <> 0 THEN coalesce(b.item_order, []) END AS item_order, coalesce(p.augments, []) AS augments
    FROM o JOIN matches m USING (mn) JOIN teams t ON t.mn = o.mn AND t.subteam_id = o.subteam_id
    LEFT JOIN held h ON h.l_orderkey = o.o_orderkey LEFT JOIN bought b ON b.l_orderkey = o.o_orderkey LEFT JOIN picked p ON p.l_orderkey = o.o_orderkey
    WHERE m.ingested),
players AS (
    SELECT player_id AS id, 'P' || lpad(CAST(player_id AS VARCHAR), 4, '0') AS puuid, CASE WHEN player_id % 10 <> 9 THEN 'Player ' || player_id || '#EUW' END AS riot_id,
           count(*) AS games, count(*) FILTER (placement = 1) AS top1_wins, count(*) FILTER (placement <= 3) AS top3_wins, CAST(sum(placement) AS BIGINT) AS placement_sum
    FROM part GROUP BY 1),
ranked AS (SELECT *, 25 + (3.5 - placement_sum / games) AS mu, count(*) OVER () AS size FROM players),
positions AS (SELECT *, row_number() OVER (ORDER BY mu DESC, games DESC, id) AS pos FROM ranked),
bounds AS (
    SELECT *, least(10, greatest(1, floor(size * 0.01 + 0.5))) AS c, least(15, greatest(1, floor(size * 0.015 + 0.5))) AS g, greatest(1, floor(size * 0.01 + 0.5)) AS m FROM positions),
ratings AS (
    SELECT id, puuid, coalesce(riot_id, puuid) AS riot_id, games, top1_wins, top3_wins, placement_sum, mu, CAST(pos AS INTEGER) AS rank_position,
           CASE WHEN pos <= c THEN 'Challenger' WHEN pos <= c + g THEN 'Grandmaster' WHEN pos <= c + g + m THEN 'Master'
                ELSE coalesce(['Diamond', 'Emerald', 'Platinum', 'Gold', 'Silver', 'Bronze', 'Iron'][
                    1 + len(list_filter([4.0, 17.0, 35.0, 59.0, 80.0, 96.0], lambda x: pos - c - g - m > floor((size - c - g - m) * x / 99.4 + 0.5)))], 'Iron') END AS tier
    FROM bounds),
ref_items AS (
    SELECT CAST(1000 + n AS INTEGER) AS id, 'Item ' || n AS name, CASE WHEN n <= 3 THEN 'boots' WHEN n <= 15 THEN 'prismatic' WHEN n <= 18 THEN 'excluded' END AS category,
           CAST(CASE WHEN n >= 56 THEN 980 + n ELSE 1000 + n END AS INTEGER) AS base_id FROM range(60) t(n)
    UNION ALL SELECT CAST(220008 + n AS INTEGER), 'Away', 'excluded', CAST(220008 + n AS INTEGER) FROM range(4) t(n)),
afk AS (SELECT DISTINCT match_id, subteam_id FROM part WHERE list_has_any(items, [220008, 220009, 220010, 220011])),
buckets AS (
    SELECT id, CAST(CASE WHEN tier IN ('Challenger', 'Grandmaster', 'Master') THEN 1 WHEN tier IN ('Diamond', 'Emerald') THEN 2 WHEN tier = 'Platinum' THEN 3
                         WHEN tier = 'Gold' THEN 4 ELSE 5 END AS INTEGER) AS skill_bucket FROM ratings),
clean AS (SELECT part.*, b.skill_bucket FROM part JOIN buckets b ON b.id = part.player_id ANTI JOIN afk USING (match_id, subteam_id)),
cur AS (SELECT * FROM clean WHERE patch = '16.19'),
archive AS (
    SELECT player_id, champion, patch, count(*) AS games, count(*) FILTER (placement = 1) AS top1_wins, count(*) FILTER (placement <= 3) AS top3_wins, CAST(sum(placement) AS BIGINT) AS placement_sum
    FROM clean WHERE patch IN ('16.8', '16.9') GROUP BY ALL),
augs AS (SELECT champion, placement, a AS augment_id, row_number() OVER (PARTITION BY match_id, player_id ORDER BY i) AS slot
         FROM (SELECT champion, placement, match_id, player_id, unnest(augments) AS a, generate_subscripts(augments, 1) AS i FROM cur) WHERE a NOT IN (5, 13)),
acq AS (
    SELECT u.champion, r.base_id AS item_id, CASE WHEN c.category = 'prismatic' THEN 'prismatic' ELSE 'bought' END AS kind,
           CAST(CASE WHEN c.category = 'prismatic' THEN u.held
                ELSE coalesce(nullif(list_position(u.item_order, r.base_id), 0), nullif(list_position(u.item_order, u.raw), 0)) END AS INTEGER) AS landmark, u.skill_bucket, u.placement
    FROM (SELECT *, len(list_filter(items, lambda x: x BETWEEN 1004 AND 1015)) AS held, unnest(items) AS raw FROM cur) u
    LEFT JOIN ref_items r ON r.id = u.raw LEFT JOIN ref_items c ON c.id = r.base_id WHERE c.category IS DISTINCT FROM 'excluded'),
grid AS (
    SELECT item_id, kind, landmark, skill_bucket, count(*) AS n, CAST(sum(placement) AS BIGINT) AS placement_sum, count(*) FILTER (placement = 1) AS top1_wins, count(*) FILTER (placement <= 3) AS top3_wins
    FROM acq GROUP BY ALL),
anvil AS (SELECT *, augments[1] AS opener, len(list_filter(items, lambda x: NOT (x BETWEEN 1004 AND 1018 OR x BETWEEN 220008 AND 220011))) = 0 AS run FROM cur),
full_teams AS (SELECT match_id, subteam_id, list_sort(list(champion)) AS cs FROM cur GROUP BY 1, 2 HAVING count(*) = 3),
codes AS (
    SELECT champion, match_id, player_id, placement, CAST(r.base_id AS BIGINT) AS code FROM (SELECT *, unnest(items) AS raw FROM cur) u
    JOIN ref_items r ON r.id = u.raw JOIN ref_items c ON c.id = r.base_id WHERE c.category IS NULL OR c.category = 'prismatic'
    UNION ALL SELECT champion, match_id, player_id, placement, 4194304 + a FROM (SELECT *, unnest(augments) AS a FROM cur) WHERE a NOT IN (5, 13)),
combos AS (
    SELECT CAST(x.code AS INTEGER) AS a, CAST(y.code AS INTEGER) AS b, x.champion,
           CASE WHEN y.code < 4194304 THEN 'item-item' WHEN x.code >= 4194304 THEN 'augment-augment' ELSE 'item-augment' END AS category, x.placement
    FROM codes x JOIN codes y ON x.match_id = y.match_id AND x.player_id = y.player_id AND y.code > x.code)
"""

_C4 = "count(*) AS games, count(*) FILTER (placement = 1) AS top1_wins, count(*) FILTER (placement <= 3) AS top3_wins, CAST(sum(placement) AS BIGINT) AS placement_sum"
_S4 = "CAST(sum(games) AS BIGINT) AS games, CAST(sum(top1_wins) AS BIGINT) AS top1_wins, CAST(sum(top3_wins) AS BIGINT) AS top3_wins, CAST(sum(placement_sum) AS BIGINT) AS placement_sum"
_N4 = "CAST(sum(n) AS BIGINT) AS n, CAST(sum(placement_sum) AS BIGINT) AS placement_sum, CAST(sum(top1_wins) AS BIGINT) AS top1_wins, CAST(sum(top3_wins) AS BIGINT) AS top3_wins"
_COMBO = f"(SELECT a, b, category, {_C4} FROM combos GROUP BY a, b, category HAVING count(*) >= 5)"


def _rates(denominator: str) -> str:
    g = "games"
    return (f"round(top3_wins / {g}, 6) AS top3_rate, round(top1_wins / {g}, 6) AS top1_rate, round(placement_sum / {g}, 6) AS avg_placement, "
            f"round({g} / ({denominator}), 6) AS play_rate")


def _if(cond: str, prefix: str = "") -> str:
    return (f"count(*) FILTER ({cond}) AS {prefix}games, count(*) FILTER ({cond} AND placement = 1) AS {prefix}top1_wins, "
            f"count(*) FILTER ({cond} AND placement <= 3) AS {prefix}top3_wins, CAST(coalesce(sum(placement) FILTER ({cond}), 0) AS BIGINT) AS {prefix}placement_sum")


def _scores(source: str, keys: str, by: str, placement: str = "placement_sum / games", top1: str = "top1_wins / games", top3: str = "top3_wins / games") -> str:
    """Tier score of each row of ``source`` among those with the same ``by``."""
    over = f"OVER (PARTITION BY {by})"
    unit = lambda x: f"CASE WHEN max({x}) {over} - min({x}) {over} < 1e-12 THEN 0.5 ELSE ({x} - min({x}) {over}) / (max({x}) {over} - min({x}) {over}) END"
    shrink = lambda r: f"(games * {r} + k * avg({r}) {over}) / (games + k)"
    return f"""(SELECT {keys}, games, 0.6 * {unit('p')} + 0.2 * {unit('t1')} + 0.2 * {unit('t3')} + 0.2 * {unit('lg')} AS score FROM (
        SELECT *, -({shrink('r0')}) AS p, {shrink('r1')} AS t1, {shrink('r2')} AS t3, ln(1 + games) AS lg FROM (
            SELECT *, {placement} AS r0, {top1} AS r1, {top3} AS r2, greatest(50, quantile_cont(games, 0.5) OVER (PARTITION BY {by})) AS k FROM {source})))"""


_CHAMPIONS = f"(SELECT champion, {_C4} FROM cur GROUP BY champion)"
_LEVELS = f"""(SELECT kind, landmark, skill_bucket, CAST(grouping(kind, landmark, skill_bucket) AS INTEGER) AS level, {_N4} FROM grid WHERE landmark IS NOT NULL
    GROUP BY GROUPING SETS ((kind, landmark, skill_bucket), (kind, landmark), (kind)))"""
_ADJUSTED = f"""(SELECT raw.item_id, raw.kind, raw.games, raw.placement_sum, raw.top1_wins, raw.top3_wins,
    coalesce(least(6.0, greatest(1.0, z.placement_sum / z.n + d0 / d.known)), raw.placement_sum / raw.games) AS tier_placement,
    coalesce(least(1.0, greatest(0.0, z.top3_wins / z.n + d2 / d.known)), raw.top3_wins / raw.games) AS tier_top3,
    coalesce(least(1.0, greatest(0.0, z.top1_wins / z.n + d1 / d.known)), raw.top1_wins / raw.games) AS tier_top1
    FROM (SELECT item_id, kind, CAST(sum(n) AS BIGINT) AS games, CAST(sum(placement_sum) AS BIGINT) AS placement_sum, CAST(sum(top1_wins) AS BIGINT) AS top1_wins, CAST(sum(top3_wins) AS BIGINT) AS top3_wins FROM grid GROUP BY 1, 2) raw
    LEFT JOIN (
        SELECT g.item_id, sum(g.n) AS known,
               sum(g.placement_sum - g.n * coalesce(f.placement_sum / f.n, c.placement_sum / c.n)) AS d0,
               sum(g.top1_wins - g.n * coalesce(f.top1_wins / f.n, c.top1_wins / c.n)) AS d1,
               sum(g.top3_wins - g.n * coalesce(f.top3_wins / f.n, c.top3_wins / c.n)) AS d2
        FROM grid g JOIN {_LEVELS} c ON c.level = 1 AND c.kind = g.kind AND c.landmark = g.landmark
        LEFT JOIN {_LEVELS} f ON f.level = 0 AND f.n >= 40 AND f.kind = g.kind AND f.landmark = g.landmark AND f.skill_bucket = g.skill_bucket
        GROUP BY 1) d ON d.item_id = raw.item_id
    LEFT JOIN {_LEVELS} z ON z.level = 3 AND z.kind = raw.kind)"""
_OF_CHAMPION = f"""(SELECT raw.champion, raw.item_id, raw.kind, raw.games, raw.placement_sum, raw.top1_wins, raw.top3_wins,
    coalesce(least(6.0, greatest(1.0, z.placement_sum / z.n + d0 / d.known)), raw.placement_sum / raw.games) AS tier_placement,
    coalesce(least(1.0, greatest(0.0, z.top3_wins / z.n + d2 / d.known)), raw.top3_wins / raw.games) AS tier_top3,
    coalesce(least(1.0, greatest(0.0, z.top1_wins / z.n + d1 / d.known)), raw.top1_wins / raw.games) AS tier_top1
    FROM (SELECT champion, item_id, kind, {_C4} FROM %(acq)s GROUP BY 1, 2, 3) raw
    LEFT JOIN (
        SELECT g.champion, g.item_id, count(*) AS known, sum(g.placement - coalesce(f.placement_sum / f.n, c.placement_sum / c.n)) AS d0,
               sum(CAST(g.placement = 1 AS INTEGER) - coalesce(f.top1_wins / f.n, c.top1_wins / c.n)) AS d1,
               sum(CAST(g.placement <= 3 AS INTEGER) - coalesce(f.top3_wins / f.n, c.top3_wins / c.n)) AS d2
        FROM %(acq)s g JOIN {_LEVELS} c ON c.level = 1 AND c.kind = g.kind AND c.landmark = g.landmark
        LEFT JOIN {_LEVELS} f ON f.level = 0 AND f.n >= 40 AND f.kind = g.kind AND f.landmark = g.landmark AND f.skill_bucket = g.skill_bucket
        GROUP BY 1, 2) d ON d.champion = raw.champion AND d.item_id = raw.item_id
    LEFT JOIN {_LEVELS} z ON z.level = 3 AND z.kind = raw.kind)"""
_ALL_ITEMS = _OF_CHAMPION % {"acq": "acq"}
_ANVIL_ITEMS = _OF_CHAMPION % {"acq": "(SELECT * FROM acq_anvil WHERE kind = 'prismatic')"}
_PACKED = """SELECT champion, CAST(row_number() OVER (PARTITION BY champion ORDER BY games DESC, item_id) - 1 AS INTEGER) AS pos, item_id, games, top1_wins, top3_wins, placement_sum,
    floor(tier_placement * 10000 + 0.5) / 10000 AS tier_placement, floor(tier_top3 * 10000 + 0.5) / 10000 AS tier_top3, floor(tier_top1 * 10000 + 0.5) / 10000 AS tier_top1
    FROM %s WHERE games >= %d"""
_PRISMATIC = f"""(SELECT *, row_number() OVER (PARTITION BY champion ORDER BY round(score, 9) DESC, item_id) AS position FROM
    {_scores(f"(SELECT * FROM {_ALL_ITEMS} WHERE kind = 'prismatic')", 'champion, item_id', 'champion', 'tier_placement', 'tier_top1', 'tier_top3')})"""
_RARITY = "CASE augment_id % 3 WHEN 0 THEN 'silver' WHEN 1 THEN 'gold' ELSE 'prismatic' END"
_SCORED = f"(SELECT *, top3_wins / games AS top3_rate, top1_wins / games AS top1_rate, placement_sum / games AS avg_placement FROM {_CHAMPIONS} JOIN {_scores(_CHAMPIONS, 'champion', '1')} USING (champion, games))"
_SORTS = {"tier": ("score", "DESC"), "top3": ("top3_rate", "DESC"), "top1": ("top1_rate", "DESC"), "avg": ("avg_placement", "ASC"), "play_rate": ("games", "DESC"), "games": ("games", "DESC")}
_TURNED = {"ASC": "DESC", "DESC": "ASC"}
_SLOTS = f"""(SELECT champion, CAST(slot AS INTEGER) AS slot, item_id, {_C4} FROM (
    SELECT champion, placement, 1 AS slot, list_filter(usable, lambda x: x BETWEEN 1000 AND 1003)[1] AS item_id FROM usable
    UNION ALL SELECT champion, placement, 2, unnest(list_filter(items, lambda x: x BETWEEN 1004 AND 1015)) FROM usable
    UNION ALL SELECT champion, placement, 2 + i, rest[i] FROM (SELECT *, list_filter(usable, lambda x: x >= 1016) AS rest FROM usable), range(1, 5) t(i))
    WHERE item_id IS NOT NULL GROUP BY ALL)"""
_USABLE = """, usable AS (SELECT champion, placement, items, list_filter(CASE WHEN len(item_order) > 0 THEN item_order ELSE items END,
    lambda x: NOT (x BETWEEN 1016 AND 1018 OR x BETWEEN 220008 AND 220011)) AS usable FROM cur)"""
_ACQ_ANVIL = """, acq_anvil AS (
    SELECT u.champion, r.base_id AS item_id, CASE WHEN c.category = 'prismatic' THEN 'prismatic' ELSE 'bought' END AS kind,
           CAST(CASE WHEN c.category = 'prismatic' THEN u.held END AS INTEGER) AS landmark, u.skill_bucket, u.placement
    FROM (SELECT *, len(list_filter(items, lambda x: x BETWEEN 1004 AND 1015)) AS held, unnest(items) AS raw FROM anvil WHERE run) u
    LEFT JOIN ref_items r ON r.id = u.raw LEFT JOIN ref_items c ON c.id = r.base_id WHERE c.category IS DISTINCT FROM 'excluded')"""
_CHOSEN = """, chosen AS (
    SELECT match_id, patch FROM matches WHERE ingested AND mn % 4 <> 1 AND mn % 3 <> 0 AND patch NOT IN ('16.18', '16.19') ORDER BY match_id LIMIT 100)"""
#: Replay of each order's line items in order of time; selling and undoing take the last of that item away.
_REPLAY = """WITH RECURSIVE e AS (
    SELECT l_orderkey, l_returnflag AS f, CAST(1000 + l_partkey % 60 AS INTEGER) AS item,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'ITEM_SOLD' WHEN 'A' THEN 'ITEM_UNDO' ELSE 'ITEM_PURCHASED' END, l_partkey % 60) AS i
    FROM lineitem),
r AS (
    SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS inv FROM e
    UNION ALL
    SELECT l_orderkey, i, CASE WHEN f NOT IN ('R', 'A') THEN list_append(inv, item) WHEN p > 0 THEN list_concat(inv[:len(inv) - p], inv[len(inv) - p + 2:]) ELSE inv END
    FROM (SELECT e.*, r.inv, coalesce(list_position(list_reverse(r.inv), e.item), 0) AS p FROM r JOIN e ON e.l_orderkey = r.l_orderkey AND e.i = r.i + 1)),
z AS (SELECT l_orderkey, max_by(inv, i) AS inv FROM r GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(inv, lambda x, i: list_position(inv, x) = i), ',') AS item_order FROM z"""
_QUEUE = """WITH q AS (
    SELECT 'Q' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS puuid, c_custkey %% 3 AS priority, c_custkey %% 7 AS error_count,
           CASE WHEN c_custkey %% 4 <> 0 THEN c_custkey * 7919 %% 86400 END AS last, c_custkey * 31 %% 5000 AS seen,
           CASE WHEN c_custkey %% 11 = 0 THEN 43200 + c_custkey %% 40000 END AS asked
    FROM customer),
req AS (SELECT puuid, asked FROM q WHERE asked IS NOT NULL AND error_count < 5 AND (last IS NULL OR last < asked) ORDER BY asked, puuid LIMIT %d)"""
_ROLE = "['Assassin', 'Fighter', 'Mage', 'Marksman', 'Support', 'Tank'][1 + CAST(substr(champion, 2) AS INTEGER) % 6]"
_ARCHETYPES = f"""(SELECT array_to_string(roles, ',') AS roles, {_C4} FROM (
    SELECT match_id, subteam_id, min(placement) AS placement, list_sort(list({_ROLE})) AS roles FROM cur GROUP BY 1, 2 HAVING count(*) = 3) GROUP BY 1 HAVING count(*) >= 5)"""
_FOLD = "translate(lower(%s), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"

_BODIES = {
    "participants_clean": """SELECT match_id, player_id, patch, subteam_id, placement, champion, skill_bucket, array_to_string(items, ',') AS items,
        array_to_string(augments, ',') AS augments, array_to_string(item_order, ',') AS item_order FROM clean""",
    "participants_published": "SELECT patch, count(*) AS n, count(DISTINCT match_id) AS matches FROM clean WHERE patch IN ('16.18', '16.19') GROUP BY 1",
    "afk_teams": "SELECT * FROM afk",
    "skill_buckets": "SELECT skill_bucket, count(*) AS players FROM buckets GROUP BY 1",
    "patch_options": "SELECT patch, count(*) AS matches, strftime(max(game_creation), '%Y-%m-%d %H:%M:%S') AS newest FROM matches WHERE ingested GROUP BY 1 HAVING count(*) >= 5",
    "patch_context": """SELECT patch, count(*) AS matches, (patch = '16.18') = ((SELECT count(*) FROM matches WHERE ingested AND patch = '16.19') < 5000) AS is_default
        FROM matches WHERE ingested AND patch IN ('16.18', '16.19') GROUP BY 1""",
    "patch_match_count": "SELECT count(DISTINCT match_id) AS matches FROM cur",
    "site_totals": """SELECT (SELECT count(*) FROM matches WHERE ingested) AS total_matches, (SELECT count(DISTINCT champion) FROM part) AS total_champions,
        (SELECT count(*) FROM players) AS total_players""",
    "champion_stats": f"SELECT * FROM {_CHAMPIONS}",
    "champion_placement_counts": "SELECT champion, concat_ws(',', " + ", ".join(f"count(*) FILTER (placement = {i})" for i in range(1, 7)) + ") AS placement_counts FROM cur GROUP BY 1",
    "champion_rates": f"SELECT *, {_rates('18 * (SELECT count(DISTINCT match_id) FROM cur)')} FROM {_CHAMPIONS}",
    "champion_placement_shares": """SELECT champion, placement, round(share, 6) AS share, round(share / greatest(0.3, max(share) OVER (PARTITION BY champion)), 6) AS bar FROM (
        SELECT c.champion, CAST(i AS INTEGER) AS placement, count(*) FILTER (c.placement = i) / count(*) AS share FROM cur c, range(1, 7) t(i) GROUP BY ALL)""",
    "previous_patch_champion_totals": "SELECT patch, champion, count(*) AS games, CAST(sum(placement) AS BIGINT) AS placement_sum FROM clean WHERE patch = '16.18' GROUP BY ALL",
    "previous_patch_archived": "SELECT patch, champion, count(*) AS games, CAST(sum(placement) AS BIGINT) AS placement_sum FROM clean WHERE patch = '16.9' GROUP BY ALL",
    "champion_movers": """SELECT champion, games, games_before, round(a, 6) AS avg_placement, round(b, 6) AS avg_before, round(a - b, 6) AS delta FROM (
        SELECT champion, count(*) FILTER (patch = '16.19') AS games, count(*) FILTER (patch = '16.18') AS games_before, avg(placement) FILTER (patch = '16.19') AS a, avg(placement) FILTER (patch = '16.18') AS b
        FROM clean GROUP BY 1) WHERE games > 0 AND games_before > 0 AND abs(a - b) > 1 * sqrt(35 / 12) * sqrt(1 / games + 1 / games_before)""",
    "champion_item_grid": f"SELECT champion, item_id, kind, landmark, skill_bucket, count(*) AS n, {_C4.split(',', 1)[1]} FROM acq WHERE kind = 'prismatic' GROUP BY 1, 2, 3, 4, 5",
    "champion_items": _PACKED % (_ALL_ITEMS, 5),
    "champion_anvil_items": _PACKED % (_ANVIL_ITEMS, 1),
    "champion_top_prismatics": f"SELECT champion, CAST(position AS INTEGER) AS position, item_id, games FROM {_PRISMATIC} WHERE position <= 6",
    "champion_top_augments": f"""SELECT champion, rarity, CAST(position AS INTEGER) AS position, augment_id, games FROM (
        SELECT *, row_number() OVER (PARTITION BY champion, rarity ORDER BY round(score, 9) DESC, augment_id) AS position FROM
        {_scores(f"(SELECT champion, augment_id, {_RARITY} AS rarity, {_C4} FROM augs GROUP BY 1, 2 HAVING count(*) >= 3)", 'champion, augment_id, rarity', 'champion, rarity')}) WHERE position <= 5""",
    "champion_documents": f"""SELECT c.champion, t.m AS total_matches, c.games, round(c.top3_wins / c.games, 6) AS top3_rate, round(c.games / (18 * t.m), 6) AS play_rate, i.all_items, u.all_augments, p.top_prismatic,
            n.anvil_games, n.blade_rate, k.combos_shown
        FROM {_CHAMPIONS} c CROSS JOIN (SELECT count(DISTINCT match_id) AS m FROM cur) t
        LEFT JOIN (SELECT champion, string_agg(item_id, ',' ORDER BY games DESC, item_id) AS all_items FROM (SELECT champion, item_id, count(*) AS games FROM acq GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1) i USING (champion)
        LEFT JOIN (SELECT champion, string_agg(augment_id, ',' ORDER BY games DESC, augment_id) AS all_augments FROM (SELECT champion, augment_id, count(*) AS games FROM augs GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1) u USING (champion)
        LEFT JOIN (SELECT champion, string_agg(item_id, ',' ORDER BY position) AS top_prismatic FROM {_PRISMATIC} WHERE position <= 6 GROUP BY 1) p USING (champion)
        LEFT JOIN (SELECT champion, count(*) AS anvil_games, round(count(*) FILTER (list_contains(items, 1007)) / count(*), 6) AS blade_rate FROM anvil WHERE run GROUP BY 1) n USING (champion)
        LEFT JOIN (SELECT champion, CAST(sum(least(10, n)) AS INTEGER) AS combos_shown FROM (SELECT champion, category, count(*) AS n FROM (SELECT champion, a, b, category FROM combos GROUP BY ALL HAVING count(*) >= 10) GROUP BY 1, 2) GROUP BY 1) k USING (champion)""",
    "champion_list_ranks": f"SELECT champion, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, champion) AS INTEGER) AS position, count(*) OVER () AS total FROM {_SCORED}",
    "home_podium": f"""SELECT champion, position, position <= 3 AS on_podium FROM (
        SELECT champion, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, champion) AS INTEGER) AS position FROM {_SCORED}) WHERE position <= 8""",
    "placement_meters": f"""SELECT champion, round(CASE WHEN max(avg_placement) OVER () = min(avg_placement) OVER () THEN 50.0 ELSE
        least(92, greatest(3, (max(avg_placement) OVER () - avg_placement) / (max(avg_placement) OVER () - min(avg_placement) OVER ()) * 92)) END, 6) AS meter FROM {_SCORED}""",
    "list_sort_keys": "SELECT champion, " + ", ".join(
        f"CAST(row_number() OVER (ORDER BY round({c}, 9) {d if side == 'best' else _TURNED[d]}, champion) AS INTEGER) AS {side}_{k}" for side in ("best", "worst") for k, (c, d) in _SORTS.items()) + f" FROM {_SCORED}",
    "list_page": f"SELECT champion, games FROM {_CHAMPIONS} ORDER BY games DESC, champion LIMIT 20 OFFSET 20",
    "ladder_band_starts": "SELECT puuid, rank_position, tier FROM (SELECT *, lag(tier) OVER (ORDER BY rank_position) AS above FROM ratings) WHERE tier IS DISTINCT FROM above",
    "augment_swing_order": """SELECT augment_id, CAST(row_number() OVER (ORDER BY round(swing, 9) DESC NULLS LAST, augment_id) AS INTEGER) AS position FROM (SELECT DISTINCT augment_id FROM augs) LEFT JOIN (
        SELECT augment_id, t3 / n3 - sum(t3) OVER () / sum(n3) OVER () - (t1 / n1 - sum(t1) OVER () / sum(n1) OVER ()) AS swing FROM (
            SELECT augment_id, """ + ", ".join(f"count(*) FILTER (slot = {k}) AS n{k}, count(*) FILTER (slot = {k} AND placement <= 3) AS t{k}" for k in (1, 2, 3)) + """
            FROM augs GROUP BY 1) WHERE least(n1, n2, n3) >= 30) USING (augment_id)""",
    "list_tabs": f"""SELECT DISTINCT 'items' AS list, item_id AS id, CASE WHEN kind = 'prismatic' THEN 'prismatic' ELSE 'legendary' END AS tab FROM acq
        UNION ALL SELECT DISTINCT 'augments', augment_id, {_RARITY} FROM augs""",
    "augment_rates": f"SELECT *, {_rates('18 * (SELECT count(DISTINCT match_id) FROM cur)')} FROM (SELECT augment_id, {_C4} FROM augs GROUP BY 1)",
    "combo_rates": f"""SELECT *, {_rates('18 * (SELECT count(DISTINCT match_id) FROM cur)')} FROM (
        SELECT c.*, CAST(row_number() OVER (PARTITION BY category ORDER BY round(t.score, 9) DESC, a, b) AS INTEGER) AS position FROM {_COMBO} c
        JOIN {_scores(_COMBO, 'a, b, category', 'category')} t USING (a, b, category)) WHERE position <= 20""",
    "leaderboard_rates": f"""SELECT puuid, rank_position, count(*) OVER () AS ranked_players, {_rates('(SELECT count(*) FROM matches WHERE ingested)')} FROM ratings QUALIFY rank_position <= 50""",
    "rating_matches_page": """SELECT match_id, string_agg(player_id, ',' ORDER BY player_id) AS players FROM clean
        WHERE (game_creation, match_id) > (TIMESTAMP '1995-01-20 00:00:00', 'M_000010') GROUP BY match_id, game_creation ORDER BY game_creation, match_id LIMIT 30""",
    "evolved_items": """SELECT match_id, player_id, array_to_string(CASE WHEN p IS NULL THEN items ELSE list_concat(items[:p - 1],
            list_filter(tail, lambda x, i: NOT list_contains(items[:p - 1], x) AND list_position(tail, x) = i)) END, ',') AS items FROM (
        SELECT *, list_transform(items[p:], lambda x: CASE WHEN x BETWEEN 1056 AND 1059 THEN x - 20 ELSE x END) AS tail FROM (
            SELECT *, list_min(list_filter(list_transform([1056, 1057, 1058, 1059], lambda e: list_position(items, e)), lambda x: x > 0)) AS p FROM cur))""",
    "deduced_patches": "SELECT match_id, CASE WHEN mn % 5 = 0 OR mn % 7 = 0 THEN '16.1' ELSE patch END AS patch FROM matches",
    "archive_totals": f"""SELECT player_id, champion, patch, {_S4} FROM (SELECT * FROM archive UNION ALL SELECT player_id, champion, patch, {_C4} FROM clean SEMI JOIN chosen USING (match_id) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
    "archive_audit": f"""SELECT patch, CAST(sum(games) AS BIGINT) AS participations, count(*) AS rows_written FROM (SELECT *, 0 AS step FROM archive
        UNION ALL SELECT player_id, champion, patch, {_C4}, 1 FROM clean SEMI JOIN chosen USING (match_id) GROUP BY 1, 2, 3) GROUP BY 1""",
    "archive_stamps": """SELECT m.match_id, CASE WHEN c.match_id IS NOT NULL THEN '2026-01-02 00:00:00' WHEN mn % 4 = 1 THEN strftime(TIMESTAMP '2026-01-01 00:00:00' + to_seconds(mn * 2), '%Y-%m-%d %H:%M:%S') END AS archived_at,
            CASE WHEN c.match_id IS NULL THEN coalesce(p.n, 0) ELSE 0 END AS rows_left
        FROM matches m LEFT JOIN chosen c USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM part GROUP BY 1) p USING (match_id)""",
    "match_documents": """SELECT match_id, 'P' || lpad(CAST(player_id AS VARCHAR), 4, '0') AS puuid, CAST(NULL AS VARCHAR) AS riot_id, champion, subteam_id, placement,
        array_to_string(augments, ',') AS augments, array_to_string(items[:7], ',') AS items FROM cur""",
    "stored_documents": "SELECT 'champion:' || champion || '@16.19' AS key, count(*) AS games, CAST(sum(placement) AS BIGINT) AS placement_sum FROM cur GROUP BY champion",
    "shredded_documents": "SELECT 'champion:' || champion || '@16.19' AS key, count(*) AS games, CAST(sum(placement) AS BIGINT) AS placement_sum FROM cur GROUP BY champion",
    "augment_stats": f"SELECT augment_id, {_C4} FROM augs GROUP BY 1",
    "champion_augment_stats": f"SELECT champion, augment_id, {_C4} FROM augs GROUP BY 1, 2 HAVING count(*) >= 5",
    "augment_timing": f"SELECT CAST(slot AS INTEGER) AS slot, augment_id, {_C4} FROM augs WHERE slot <= 3 GROUP BY 1, 2",
    "augment_timing_swing": """SELECT augment_id, round(t1 / n1, 6) AS rate_1, round(t2 / n2, 6) AS rate_2, round(t3 / n3, 6) AS rate_3,
            round(t3 / n3 - sum(t3) OVER () / sum(n3) OVER () - (t1 / n1 - sum(t1) OVER () / sum(n1) OVER ()), 6) AS swing FROM (
        SELECT augment_id, """ + ", ".join(f"count(*) FILTER (slot = {k}) AS n{k}, count(*) FILTER (slot = {k} AND placement <= 3) AS t{k}" for k in (1, 2, 3)) + """
        FROM augs GROUP BY 1) WHERE least(n1, n2, n3) >= 30""",
    "item_acquisitions": "SELECT * FROM grid",
    "landmark_baselines": f"SELECT kind, landmark, skill_bucket, {_N4} FROM grid WHERE landmark IS NOT NULL GROUP BY 1, 2, 3",
    "landmark_grouping_sets": f"SELECT * FROM {_LEVELS}",
    "item_raw_stats": f"SELECT item_id, kind, {_C4} FROM acq GROUP BY 1, 2",
    "item_rates": f"SELECT *, {_rates('18 * (SELECT count(DISTINCT match_id) FROM cur)')} FROM (SELECT item_id, kind, {_C4} FROM acq GROUP BY 1, 2)",
    "item_adjusted_stats": f"SELECT * REPLACE (round(tier_placement, 6) AS tier_placement, round(tier_top3, 6) AS tier_top3, round(tier_top1, 6) AS tier_top1) FROM {_ADJUSTED}",
    "item_timing_swing": """SELECT item_id, round(te / ne, 6) AS rate_early, round(tm / nm, 6) AS rate_mid, round(tl / nl, 6) AS rate_late,
            round(tl / nl - sum(tl) OVER () / sum(nl) OVER () - (te / ne - sum(te) OVER () / sum(ne) OVER ()), 6) AS swing FROM (
        SELECT item_id, """ + ", ".join(f"count(*) FILTER (landmark BETWEEN {a} AND {b}) AS n{x}, count(*) FILTER (landmark BETWEEN {a} AND {b} AND placement <= 3) AS t{x}" for x, a, b in (("e", 1, 2), ("m", 3, 3), ("l", 4, 99))) + """
        FROM acq WHERE kind = 'bought' GROUP BY 1) WHERE least(ne, nm, nl) >= 20""",
    "anvil_champions": f"SELECT champion, {_if('run')}, count(*) AS total_games FROM anvil GROUP BY 1 HAVING count(*) FILTER (run) > 0",
    "anvil_overall": f"SELECT count(DISTINCT match_id) AS total_matches, {_if('true')} FROM anvil WHERE run",
    "anvil_openers": f"SELECT opener, {_if('run', 'anvil_')}, {_if('NOT run', 'bought_')} FROM anvil WHERE opener IN (3, 7, 11, 19) GROUP BY 1",
    "anvil_opener_champions": f"SELECT opener, champion, {_C4} FROM anvil WHERE run AND opener IN (3, 7, 11, 19) GROUP BY 1, 2",
    "anvil_opener_comparison": f"""SELECT opener, round(d1, 6) AS delta_top1, round(d3, 6) AS delta_top3, round(dp, 6) AS delta_placement,
            CASE WHEN abs(d3) <= 0.002 THEN 'same' WHEN d3 > 0 THEN 'better' ELSE 'worse' END AS verdict FROM (
        SELECT opener, {", ".join(f"coalesce(a{c} / nullif(ag, 0), 0) - coalesce(b{c} / nullif(bg, 0), 0) AS d{n}" for n, c in (("1", "1"), ("3", "3"), ("p", "p")))} FROM (
            SELECT opener, count(*) FILTER (run) AS ag, count(*) FILTER (NOT run) AS bg, count(*) FILTER (run AND placement = 1) AS a1, count(*) FILTER (NOT run AND placement = 1) AS b1,
                   count(*) FILTER (run AND placement <= 3) AS a3, count(*) FILTER (NOT run AND placement <= 3) AS b3, sum(placement) FILTER (run) AS ap, sum(placement) FILTER (NOT run) AS bp
            FROM anvil WHERE opener IN (3, 7, 11, 19) GROUP BY 1))""",
    "champion_anvil_summary": f"""SELECT champion, {_C4}, {_if('coalesce(opener IN (3, 7, 11, 19), false)', 'stat_')}, {_if('NOT coalesce(opener IN (3, 7, 11, 19), false)', 'other_')},
        round(count(*) FILTER (list_contains(items, 1007)) / count(*), 6) AS blade_rate, round(avg(placement), 6) AS avg_placement FROM anvil WHERE run GROUP BY 1""",
    "comp_archetypes": f"SELECT * FROM {_ARCHETYPES}",
    "comp_coverage": """SELECT (SELECT count(*) FROM full_teams) AS total_teams, (SELECT count(DISTINCT cs) FROM full_teams) AS distinct_trios,
        (SELECT count(*) FROM (SELECT cs FROM full_teams GROUP BY 1 HAVING count(*) > 1)) AS repeated_trios, count(*) AS distinct_duos, count(*) FILTER (n >= 8) AS usable_duos
        FROM (SELECT a, b, count(*) AS n FROM (SELECT cs[1] AS a, cs[2] AS b FROM full_teams UNION ALL SELECT cs[1], cs[3] FROM full_teams UNION ALL SELECT cs[2], cs[3] FROM full_teams) GROUP BY 1, 2)""",
    "comp_rates": f"SELECT *, {_rates('(SELECT count(*) FROM full_teams)')} FROM {_ARCHETYPES}",
    "combo_stats": f"SELECT * FROM {_COMBO}",
    "combo_probe": f"SELECT count(*) AS pairs, CAST(sum(games) AS BIGINT) AS occurrences FROM {_COMBO}",
    "combo_top_by_category": f"""SELECT * FROM (SELECT c.*, CAST(row_number() OVER (PARTITION BY c.category ORDER BY round(s.score, 9) DESC, c.a, c.b) AS INTEGER) AS position
        FROM {_COMBO} c JOIN {_scores(_COMBO, 'a, b, category', 'category')} s USING (a, b)) WHERE position <= 20""",
    "champion_combos": f"SELECT champion, a, b, category, {_C4} FROM combos GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3",
    "build_slots": f"SELECT * FROM {_SLOTS}",
    "tier_scores": f"SELECT champion, games, round(score, 6) AS score FROM {_scores(_CHAMPIONS, 'champion', '1')}",
    "item_tiers": f"SELECT item_id, kind, games, round(score, 6) AS score FROM {_scores(_ADJUSTED, 'item_id, kind', 'kind', 'tier_placement', 'tier_top1', 'tier_top3')}",
    "rating_matches_packed": """SELECT match_id, string_agg(CAST(player_id AS VARCHAR), ',' ORDER BY player_id) AS players, string_agg(CAST(subteam_id AS VARCHAR), ',' ORDER BY player_id) AS subteams,
        string_agg(CAST(placement AS VARCHAR), ',' ORDER BY player_id) AS placements FROM clean GROUP BY 1""",
    "rating_rows_incremental": """SELECT match_id, string_agg(CAST(player_id AS VARCHAR), ',' ORDER BY player_id) AS players, string_agg(CAST(subteam_id AS VARCHAR), ',' ORDER BY player_id) AS subteams,
        string_agg(CAST(placement AS VARCHAR), ',' ORDER BY player_id) AS placements FROM clean GROUP BY 1""",
    "rating_entourage": """SELECT a.player_id, round(avg(r.mu) FILTER (b.subteam_id = a.subteam_id), 6) AS teammate_mu, round(avg(r.mu) FILTER (b.subteam_id <> a.subteam_id), 6) AS opponent_mu
        FROM clean a JOIN clean b ON a.match_id = b.match_id AND a.player_id <> b.player_id JOIN ratings r ON r.id = b.player_id GROUP BY 1""",
    "ladder_positions": """SELECT id AS player_id, games, round(mu, 6) AS mu, CAST(row_number() OVER (ORDER BY ratings.mu DESC, games DESC, id) AS INTEGER) AS rank_position FROM ratings WHERE games >= 5""",
    "player_counts": "SELECT player_id, count(*) AS games FROM clean GROUP BY 1",
    "player_profile": f"""SELECT *, {_rates('sum(games) OVER ()')} FROM (SELECT champion, {_S4} FROM (
        SELECT champion, {_C4} FROM clean WHERE player_id = 61 AND patch IN ('16.18', '16.19') GROUP BY 1
        UNION ALL SELECT champion, games, top1_wins, top3_wins, placement_sum FROM archive WHERE player_id = 61) GROUP BY 1)""",
    "player_top_champions": """SELECT player_id, string_agg(champion, ',' ORDER BY games DESC, champion) AS champions FROM (
        SELECT player_id, champion, sum(g) AS games, row_number() OVER (PARTITION BY player_id ORDER BY sum(g) DESC, champion) AS n FROM (
            SELECT player_id, champion, count(*) AS g FROM part WHERE patch NOT IN ('16.8', '16.9') GROUP BY 1, 2 UNION ALL SELECT player_id, champion, games FROM archive) GROUP BY 1, 2)
        WHERE n <= 3 GROUP BY 1""",
    "leaderboard_top": "SELECT puuid, riot_id, games, top3_wins, top1_wins, placement_sum, rank_position, tier, round(mu, 6) AS mu FROM ratings WHERE rank_position <= 100",
    "leaderboard_search": "SELECT puuid, riot_id, rank_position FROM ratings WHERE contains(lower(riot_id), 'player 1') ORDER BY rank_position LIMIT 25",
    "find_player": "SELECT puuid, riot_id FROM players WHERE lower(riot_id) = 'player 61#euw'",
    "rating_players": "SELECT id AS player_id, puuid, coalesce(riot_id, puuid) AS riot_id, games FROM players WHERE games >= 3 AND id > 20 ORDER BY id LIMIT 100",
    "player_rank": "SELECT puuid, rank_position, tier, (SELECT count(*) FROM ratings) AS ranked_players FROM ratings WHERE puuid = 'P0061'",
    "career_archive_merge": f"""SELECT player_id, champion, patch, {_S4} FROM (SELECT * FROM archive WHERE patch = '16.8' UNION ALL SELECT * FROM archive) GROUP BY 1, 2, 3""",
    "rolled_patches": "SELECT patch, CAST(sum(games) AS BIGINT) AS participations, count(*) AS rows_written FROM archive GROUP BY 1",
    "latest_name_per_player": """SELECT DISTINCT ON (player_id) player_id AS puuid, CASE WHEN player_id % 4 <> 0 THEN 'n' || player_id || '#' || patch END AS riot_id
        FROM part ORDER BY player_id, game_creation DESC, match_id DESC""",
    "match_cards": """SELECT match_id, string_agg(placement || ':' || subteam_id || ':' || cs, ';' ORDER BY placement, subteam_id) AS teams FROM (
        SELECT match_id, subteam_id, min(placement) AS placement, string_agg(champion, '+' ORDER BY player_id) AS cs FROM cur GROUP BY 1, 2) GROUP BY 1""",
    "patch_interval_join": """, w AS (SELECT patch, min(game_creation) AS s FROM matches WHERE mn % 3 <> 0 GROUP BY 1)
        SELECT match_id, (SELECT max_by(w.patch, struct_pack(s := w.s, p := w.patch)) FROM w WHERE w.s <= m.game_creation) AS patch_deduced FROM matches m WHERE mn % 3 = 0""",
    "new_match_ids": "SELECT match_id FROM matches WHERE NOT (ingested AND mn % 2 = 0)",
    "refdata_canonical_items": """, h AS (SELECT id, count(*) AS held FROM (SELECT unnest(items) AS id FROM cur) GROUP BY 1)
        SELECT h.id, coalesce(base_id, h.id) AS base_id, category, held FROM h LEFT JOIN ref_items r ON r.id = h.id""",
    "point_lookup": "SELECT p.puuid, c.match_id, c.champion, c.placement FROM players p JOIN clean c ON c.player_id = p.id WHERE lower(p.riot_id) = 'player 61#euw' AND p.id = 61",
    "surrogate_ids": """, l AS (SELECT player_id, CAST(substr(match_id, 3) AS INTEGER) AS mn FROM part),
        f AS (SELECT 'P' || lpad(CAST(player_id AS VARCHAR), 4, '0') AS puuid, CAST(min(CASE WHEN mn % 40 = 0 THEN 0 WHEN mn % 4 = 0 THEN 1 ELSE 2 END) AS INTEGER) AS load FROM l GROUP BY player_id)
        SELECT puuid, row_number() OVER (ORDER BY load, puuid) - 1 AS id, load FROM f""",
    "match_persist": """SELECT 'P' || lpad(CAST(player_id AS VARCHAR), 4, '0') AS puuid, CASE WHEN player_id % 4 <> 0 THEN 'n' || player_id || '#' || max_by(patch, struct_pack(a := game_creation, b := match_id)) END AS riot_id,
        count(*) AS games, CAST(sum(placement) AS BIGINT) AS placement_sum FROM part WHERE CAST(substr(match_id, 3) AS INTEGER) % 9 <> 4 GROUP BY player_id""",
    "ladder_tiers": """, r AS (SELECT id, row_number() OVER (ORDER BY mu DESC, games DESC, id) AS pos, count(*) OVER () AS size FROM ratings WHERE games >= 5),
        b AS (SELECT *, least(10, greatest(1, floor(size * 0.01 + 0.5))) AS c, least(15, greatest(1, floor(size * 0.015 + 0.5))) AS g, greatest(1, floor(size * 0.01 + 0.5)) AS m FROM r)
        SELECT CASE WHEN pos <= c THEN 'Challenger' WHEN pos <= c + g THEN 'Grandmaster' WHEN pos <= c + g + m THEN 'Master'
               ELSE ['Diamond', 'Emerald', 'Platinum', 'Gold', 'Silver', 'Bronze', 'Iron'][1 + len(list_filter([4.0, 17.0, 35.0, 59.0, 80.0, 96.0], lambda x: pos - c - g - m > floor((size - c - g - m) * x / 99.4 + 0.5)))] END AS tier,
               count(*) AS players, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM b GROUP BY 1""",
    "stat_scale": f""", s AS (SELECT *, greatest(20, floor(quantile_cont(games, 0.5) OVER () / 10 + 0.5)) AS least_games FROM {_CHAMPIONS})
        SELECT CAST(any_value(least_games) AS BIGINT) AS min_games, """ + ", ".join(
            f"CASE WHEN count(*) >= 10 THEN round(quantile_cont({c} / games, {p}), 6) END AS {n}_{e}" for n, c in (("top3", "top3_wins"), ("top1", "top1_wins"), ("placement", "placement_sum")) for e, p in (("low", 0.15), ("high", 0.85)))
        + " FROM s WHERE games >= least_games",
    "stat_verdicts": f""", s AS (SELECT *, greatest(20, floor(quantile_cont(games, 0.5) OVER () / 10 + 0.5)) AS least_games FROM {_CHAMPIONS}),
        q AS (SELECT """ + ", ".join(
            f"coalesce(CASE WHEN count(*) >= 10 THEN quantile_cont({c} / games, {p}) END, {d}) AS {n}_{e}"
            for n, c, lo, hi in (("t3", "top3_wins", 0.4, 0.55), ("t1", "top1_wins", 0.13, 0.2), ("p", "placement_sum", 3.2, 3.7)) for e, p, d in (("low", 0.15, lo), ("high", 0.85, hi)))
        + """ FROM s WHERE games >= least_games)
        SELECT champion, CASE WHEN top3_wins / games >= t3_high THEN 'good' WHEN top3_wins / games <= t3_low THEN 'bad' ELSE 'neutral' END AS top3_verdict,
               CASE WHEN top1_wins / games >= t1_high THEN 'good' WHEN top1_wins / games <= t1_low THEN 'bad' ELSE 'neutral' END AS top1_verdict,
               CASE WHEN placement_sum / games >= p_high THEN 'bad' WHEN placement_sum / games <= p_low THEN 'good' ELSE 'neutral' END AS placement_verdict FROM s, q""",
    "snapshot_diff": """, v AS (SELECT patch, champion AS key, unnest(['games', 'placement_sum']) AS path, unnest([count(*), sum(placement)]) AS value FROM clean WHERE patch IN ('16.18', '16.19') GROUP BY 1, 2)
        SELECT key, path, CAST(CAST(a.value AS BIGINT) AS VARCHAR) AS a, CAST(CAST(b.value AS BIGINT) AS VARCHAR) AS b, CASE WHEN a.value IS NULL OR b.value IS NULL THEN 'one side' ELSE 'difference' END AS kind,
               CAST(abs(a.value - b.value) AS DOUBLE) AS gap
        FROM (SELECT * FROM v WHERE patch = '16.18') a FULL JOIN (SELECT * FROM v WHERE patch = '16.19') b USING (key, path) WHERE a.value IS DISTINCT FROM b.value""",
    "rating_match_update": """, p AS (
            SELECT c.match_id, c.player_id, c.subteam_id, c.placement, coalesce(r.mu, 25) AS mu, least(sqrt(pow(25 / 3 * 0.8, 2) + pow(25 / 300, 2)), 25 / 3) AS sigma
            FROM cur c LEFT JOIN ratings r ON r.id = c.player_id),
        t AS (SELECT match_id, subteam_id, min(placement) AS place, sum(mu) AS mu, sum(sigma * sigma) AS v FROM p GROUP BY 1, 2),
        n AS (SELECT match_id, sqrt(sum(v + pow(25 / 6, 2))) AS c FROM t GROUP BY 1 HAVING count(*) > 1),
        s AS (SELECT t.*, n.c, exp(t.mu / n.c) AS e FROM t JOIN n USING (match_id)),
        q AS (SELECT a.match_id, a.subteam_id AS q, a.place AS q_place, sum(b.e) FILTER (b.place >= a.place) AS remaining, count(*) FILTER (b.place = a.place) AS tied FROM s a JOIN s b USING (match_id) GROUP BY 1, 2, 3),
        d AS (
            SELECT s.match_id, s.subteam_id, s.v, s.c, sum(CASE WHEN q.q = s.subteam_id THEN 1 - s.e / remaining ELSE -s.e / remaining END / tied) AS omega, sum(s.e / remaining * (1 - s.e / remaining) / tied) AS delta
            FROM s JOIN q ON q.match_id = s.match_id AND q.q_place <= s.place GROUP BY 1, 2, 3, 4)
        SELECT p.match_id, p.player_id, round(p.mu + sigma * sigma / v * (omega * v / c), 6) AS mu,
               round(sigma * sqrt(greatest(1 - sigma * sigma / v * (delta * v / (c * c) * sqrt(v) / c), 1e-4)), 6) AS sigma
        FROM p JOIN d ON d.match_id = p.match_id AND d.subteam_id = p.subteam_id""",
}

#: The queue of requests in order: a full window (two in half a day, five in five days) is waited for, and a wait beyond the limit is refused.
_TURNS = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        r AS (
            SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS times, CAST(NULL AS BIGINT) AS wait_us FROM e
            UNION ALL
            SELECT user_id, event_id, i, CASE WHEN ok THEN list_append(times, go)[-5:] ELSE times END, CASE WHEN ok THEN go - t END
            FROM (SELECT *, coalesce(go <= turn + CAST(%(wait)s AS BIGINT), true) AS ok
                  FROM (SELECT *, coalesce(greatest(CASE WHEN len(times) >= 2 AND turn < times[-2] + 43200000000 THEN times[-2] + 43200000000 END,
                                                    CASE WHEN len(times) = 5 AND turn < times[1] + 432000000000 THEN times[1] + 432000000000 END) + 1000, turn) AS go
                        FROM (SELECT e.*, r.times, greatest(e.t, coalesce(r.times[-1], e.t)) AS turn FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))))
        SELECT event_id, user_id, wait_us FROM r WHERE i > 0"""

_ADMITTED = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (
        SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS times, false AS admitted FROM e
        UNION ALL
        SELECT user_id, event_id, i, CASE WHEN ok THEN list_append(times, t)[-3:] ELSE times END, ok
        FROM (SELECT e.*, r.times, len(r.times) < 3 OR r.times[1] <= e.t - 86400000000 AS ok FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
    SELECT user_id, event_id, admitted FROM r WHERE i > 0"""

_TABLES = {
    "queue_after_visits": _QUEUE % 25 + """ SELECT puuid, CAST(CASE WHEN k % 5 = 0 THEN 0 WHEN k % 5 = 1 THEN error_count + 1 ELSE error_count END AS INTEGER) AS error_count,
        CASE WHEN k % 5 < 2 THEN '2026-01-02 00:00:00' ELSE strftime(TIMESTAMP '2026-01-01 00:00:00' + to_seconds(last), '%Y-%m-%d %H:%M:%S') END AS last_crawled_at
        FROM (SELECT *, CAST(substr(puuid, 2) AS INTEGER) AS k FROM q)""",
    "rate_limit_waits": _TURNS % {"wait": "NULL"},
    "rate_limit_refusals": _TURNS % {"wait": "86400000000"},
    "rate_limit_paced": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        r AS (
            SELECT DISTINCT user_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS times, CAST(NULL AS BIGINT) AS t FROM e
            UNION ALL
            SELECT user_id, event_id, i, list_append(times, go)[-5:], t
            FROM (SELECT e.*, r.times, greatest(e.t, coalesce(r.times[-1], 0), coalesce(r.times[-2], 0) + 43200001000, CASE WHEN len(r.times) = 5 THEN r.times[1] ELSE -432000001000 END + 432000001000) AS go
                  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
        SELECT event_id, user_id, times[-1] - t AS wait_us FROM r WHERE i > 0""",
    "timeline_item_order": _REPLAY,
    "timeline_documents": _REPLAY,
    "admission_control": _ADMITTED,
    "entity_search": """SELECT DISTINCT kind, name FROM (SELECT 'part' AS kind, p_name AS name FROM part UNION ALL SELECT 'customer', c_name FROM customer)
        WHERE contains(lower(name), '01') ORDER BY kind DESC, name LIMIT 8""",
    "name_index_search": r"""WITH n AS (
            SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Élan' || substr(c_name, 9) WHEN 1 THEN '50% ' || c_name WHEN 2 THEN 'a_' || c_name WHEN 3 THEN 'b\' || c_name ELSE 'ÉN ' || c_name END AS name
            FROM customer),
        s AS (SELECT unnest(['ELAN#0000001', '0% c', '_c', '\', 'é', 'mer#00000013', 'no such name', 'én', '1']) AS sought)
        SELECT sought, c_custkey, name FROM s JOIN n ON length(sought) > 1 AND contains(lower(name), lower(sought))""",
    "history_pages": """SELECT CAST(o_custkey % 16 AS INTEGER) AS list, count(*) AS read, max('M_' || o_orderkey) AS read_last, CAST(sum(epoch(o_orderdate)) AS BIGINT) AS read_sum,
        count(*) AS streamed, max('M_' || o_orderkey) AS streamed_last, CAST(sum(epoch(o_orderdate)) AS BIGINT) AS streamed_sum FROM orders GROUP BY 1""",
    "admission_stream": _ADMITTED,
    "queue_promoted": _QUEUE % 25 + """, p AS (SELECT CASE WHEN c_custkey % 12 = 1 THEN 'Z' ELSE 'Q' END || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS puuid, c_custkey * 13 % 50 AS games FROM customer WHERE c_custkey % 3 <> 2)
        SELECT q.puuid, CAST(CASE WHEN priority = 0 AND games >= 20 THEN 1 ELSE priority END AS INTEGER) AS priority, CAST(error_count AS INTEGER) AS error_count FROM q LEFT JOIN p ON p.puuid = q.puuid""",
    "queue_ladder_top": _QUEUE % 25 + """, p AS (SELECT CASE WHEN c_custkey % 12 = 1 THEN 'Z' ELSE 'Q' END || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS puuid, c_custkey * 7 % 1009 AS pos FROM customer WHERE c_custkey % 3 <> 2),
        t AS (SELECT puuid FROM p WHERE pos <= 300)
        SELECT puuid, CAST(CASE WHEN puuid IN (SELECT puuid FROM t) THEN 2 WHEN priority = 2 THEN 1 ELSE priority END AS INTEGER) AS priority, CAST(error_count AS INTEGER) AS error_count FROM q
        UNION ALL SELECT puuid, 2, NULL FROM t WHERE puuid NOT IN (SELECT puuid FROM q)""",
    "reference_etl": """SELECT 'item' AS kind, CAST(p_partkey AS INTEGER) AS id, p_name AS name, CAST(NULL AS VARCHAR) AS tier, CASE WHEN p_partkey % 10 = 3 THEN 'boots' END AS category FROM part WHERE p_partkey % 3 <> 0
        UNION ALL SELECT 'augment', CAST(p_partkey AS INTEGER), p_name, CASE p_partkey % 5 WHEN 0 THEN 'silver' WHEN 1 THEN 'gold' WHEN 2 THEN 'prismatic' WHEN 3 THEN 'silver' ELSE 'gold' END, CASE WHEN p_partkey % 10 = 3 THEN 'boots' END
        FROM part WHERE p_partkey % 4 < 2 AND p_partkey % 7 <> 0 AND p_name <> ''""",
    "requested_players": _QUEUE % 25 + " SELECT puuid FROM req",
    "crawl_queue_pick": _QUEUE % 10 + """,
        due AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY last NULLS FIRST, seen DESC, puuid) AS n FROM q WHERE error_count < 5),
        lad AS (SELECT puuid, row_number() OVER (ORDER BY last NULLS FIRST, seen DESC, puuid) AS n FROM q WHERE error_count < 5 AND priority = 2 AND (last IS NULL OR last < 86400 - 6 * 3600)),
        l AS (SELECT puuid, n FROM lad WHERE n <= 30 - (SELECT count(*) FROM req) AND puuid NOT IN (SELECT puuid FROM req)),
        a AS (SELECT puuid, 0 AS k, row_number() OVER (ORDER BY asked, puuid) AS n FROM req UNION ALL SELECT puuid, 1, n FROM l),
        t AS (SELECT * FROM a UNION ALL SELECT puuid, 2, n FROM due WHERE priority = 1 AND n <= 30 - (SELECT count(*) FROM a) AND puuid NOT IN (SELECT puuid FROM a)),
        d AS (SELECT puuid, k, n, true AS tracked FROM t UNION ALL SELECT puuid, 3, n, false FROM due WHERE priority = 0 AND n <= 60 - (SELECT count(*) FROM t)),
        e AS (SELECT * FROM d UNION ALL SELECT puuid, 4, n, true FROM due WHERE priority = 1 AND n <= 60 - (SELECT count(*) FROM d) AND puuid NOT IN (SELECT puuid FROM d))
        SELECT CAST(row_number() OVER (ORDER BY k, n) AS INTEGER) AS pick, puuid, tracked FROM e""",
    "sliding_rate_window": """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events""",
    "accent_fold_search": f"SELECT lang, count(*) AS documents FROM documents WHERE contains({_FOLD % 'text'}, 'ecole') OR contains({_FOLD % 'text'}, 'elle') GROUP BY 1",
    "html_to_text": r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(li|p|div|rules|mainText)>', chr(10), 'g'), '(?i)<li>', '• ', 'g'), '<[^>]+>', '', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '(?i)%i:[a-z0-9_]+%', '', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages""",
}


#: Tier letters: k-means on the sorted scores, near clusters made one from the left, letters by their means.
_LETTERS = f""", scored AS (SELECT champion, score, row_number() OVER (ORDER BY score) AS pos FROM {_scores(_CHAMPIONS, 'champion', '1')}),
sx AS (SELECT list(score ORDER BY score) AS xs, count(*) AS n, least(5, count(*)) AS k, max(score) - min(score) AS spread, avg(score) AS middle, stddev_pop(score) AS deviation FROM scored),
km AS (
    SELECT 0 AS it, list_transform(range(k), lambda c: xs[CAST(floor((c + 0.5) * n / k) AS INTEGER) + 1]) AS centres, CAST([] AS BIGINT[]) AS mine, false AS done FROM sx
    UNION ALL
    SELECT it + 1, list_transform(range(1, k + 1), lambda j: coalesce(list_avg(list_filter(xs, lambda x, i: new[i] = j)), centres[j])), new, new = mine
    FROM (SELECT *, list_transform(xs, lambda x: CAST(list_position(list_transform(centres, lambda c: abs(x - c)), list_min(list_transform(centres, lambda c: abs(x - c)))) AS BIGINT)) AS new
          FROM km, sx WHERE NOT done AND it < 50)),
cuts AS (SELECT CASE WHEN spread < 1e-9 THEN [1] ELSE list_filter(range(1, n + 1), lambda i: i = 1 OR mine[i] <> mine[i - 1]) END AS starts FROM sx, (SELECT mine FROM km ORDER BY it DESC LIMIT 1)),
merged AS (
    SELECT CAST(1 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS stack, CAST(NULL AS BIGINT) AS cs, CAST(NULL AS BIGINT) AS ce, 0 AS step
    UNION ALL
    SELECT CASE WHEN cs IS NULL THEN r + 1 ELSE r END, CASE WHEN cs IS NULL THEN stack WHEN near THEN stack[:len(stack) - 1] ELSE list_append(stack, cs) END,
           CASE WHEN cs IS NULL THEN starts[r] WHEN near THEN stack[len(stack)] END, CASE WHEN cs IS NULL THEN coalesce(starts[r + 1] - 1, n) WHEN near THEN ce END, step + 1
    FROM (SELECT *, len(stack) > 0 AND list_avg(xs[cs:ce]) - list_avg(xs[stack[len(stack)]:cs - 1]) < 0.08 * spread AS near FROM merged, cuts, sx WHERE cs IS NOT NULL OR r <= len(starts))),
runs AS (SELECT unnest(stack) AS a, unnest(list_append(stack[2:], n + 1)) - 1 AS b FROM (SELECT stack FROM merged ORDER BY step DESC LIMIT 1), sx)
SELECT 'champions' AS view, champion, round(score, 6) AS score, ['S', 'A', 'B', 'C', 'D'][1 + len(list_filter([0.84, 0.25, -0.25, -0.84], lambda c: (list_avg(xs[a:b]) - middle) / deviation < c))] AS tier
FROM scored JOIN runs ON pos BETWEEN a AND b, sx"""
#: The replay as a recursion over matches in order of time, three times; the state is lists by player.
_SEASON = """, pm AS (
    SELECT row_number() OVER (ORDER BY game_creation, match_id) AS k, list(player_id ORDER BY player_id) AS p, list(subteam_id ORDER BY player_id) AS t, list(placement ORDER BY player_id) AS pl
    FROM clean GROUP BY match_id, game_creation HAVING count(DISTINCT subteam_id) > 1),
size AS (SELECT count(*) AS n, (SELECT max(player_id) + 1 FROM clean) AS players FROM pm),
rp AS (
    SELECT CAST(0 AS BIGINT) AS i, list_transform(range(players), lambda x: CAST(25 AS DOUBLE)) AS mu, list_transform(range(players), lambda x: CAST(25 AS DOUBLE) / 3) AS sg FROM size
    UNION ALL
    SELECT i, list_transform(mu, lambda x, j: CASE WHEN list_contains(p, j - 1) THEN x + v[list_position(p, j - 1)] / tv[u[list_position(p, j - 1)]] * om[u[list_position(p, j - 1)]] ELSE x END),
           list_transform(sg, lambda x, j: CASE WHEN list_contains(p, j - 1) THEN
               sqrt(v[list_position(p, j - 1)] * greatest(1 - v[list_position(p, j - 1)] / tv[u[list_position(p, j - 1)]] * de[u[list_position(p, j - 1)]], 1e-4)) ELSE x END)
    FROM (
        SELECT *, list_transform(st, lambda s, a: tv[a] / c * list_sum(list_transform(rem, lambda r, q: CASE WHEN tp[q] <= tp[a] THEN ((CASE WHEN q = a THEN 1 ELSE 0 END) - s / r) / tied[q] ELSE 0 END))) AS om,
               list_transform(st, lambda s, a: tv[a] / (c * c) * sqrt(tv[a]) / c * list_sum(list_transform(rem, lambda r, q: CASE WHEN tp[q] <= tp[a] THEN s / r * (1 - s / r) / tied[q] ELSE 0 END))) AS de
        FROM (
            SELECT *, list_transform(tp, lambda z: list_sum(list_filter(st, lambda s, b: tp[b] >= z))) AS rem, list_transform(tp, lambda z: len(list_filter(tp, lambda y: y = z))) AS tied
            FROM (
                SELECT *, list_transform(tm, lambda x: exp(x / c)) AS st
                FROM (
                    SELECT *, sqrt(list_sum(tv) + len(tv) * (25.0 / 6) * (25.0 / 6)) AS c
                    FROM (
                        SELECT *, list_transform(ts, lambda z: list_sum(list_transform(list_filter(p, lambda x, j: t[j] = z), lambda x: mu[x + 1]))) AS tm,
                               list_transform(ts, lambda z: list_sum(list_filter(v, lambda x, j: t[j] = z))) AS tv, list_transform(ts, lambda z: pl[list_position(t, z)]) AS tp,
                               list_transform(t, lambda z: list_position(ts, z)) AS u
                        FROM (
                            SELECT *, list_transform(p, lambda x: least(sg[x + 1] * sg[x + 1] + (25.0 / 300) * (25.0 / 300), (25.0 / 3) * (25.0 / 3))) AS v, list_sort(list_distinct(t)) AS ts
                            FROM (
                                SELECT rp.i + 1 AS i, rp.mu, CASE WHEN rp.i % n = 0 THEN list_transform(rp.sg, lambda x: CAST(25 AS DOUBLE) / 3) ELSE rp.sg END AS sg, pm.p, pm.t, pm.pl
                                FROM rp, size JOIN pm ON pm.k = rp.i % n + 1 WHERE rp.i < 3 * n)))))))),
final AS (SELECT mu, sg FROM rp ORDER BY i DESC LIMIT 1),
played AS (SELECT player_id, count(*) AS games, count(*) FILTER (placement = 1) AS top1_wins, count(*) FILTER (placement <= 3) AS top3_wins, CAST(sum(placement) AS BIGINT) AS placement_sum
    FROM (SELECT unnest(p) AS player_id, unnest(pl) AS placement FROM pm) GROUP BY 1),
replay AS (SELECT player_id, final.mu[player_id + 1] AS mu, final.sg[player_id + 1] AS sigma, games, top1_wins, top3_wins, placement_sum FROM played, final)"""
_REPLAYED = "SELECT player_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, games, top1_wins, top3_wins, placement_sum FROM replay"
_LADDER = """SELECT player_id, round(mu, 6) AS mu, round(sigma, 6) AS sigma, games, top1_wins, top3_wins, placement_sum, CAST(pos AS INTEGER) AS rank_position,
    CASE WHEN pos <= c THEN 'Challenger' WHEN pos <= c + g THEN 'Grandmaster' WHEN pos <= c + g + m THEN 'Master'
         ELSE coalesce(['Diamond', 'Emerald', 'Platinum', 'Gold', 'Silver', 'Bronze', 'Iron'][
             1 + len(list_filter([4.0, 17.0, 35.0, 59.0, 80.0, 96.0], lambda x: pos - c - g - m > floor((size - c - g - m) * x / 99.4 + 0.5)))], 'Iron') END AS tier
    FROM (SELECT *, least(10, greatest(1, floor(size * 0.01 + 0.5))) AS c, least(15, greatest(1, floor(size * 0.015 + 0.5))) AS g, greatest(1, floor(size * 0.01 + 0.5)) AS m FROM (
        SELECT *, row_number() OVER (ORDER BY mu DESC, games DESC, player_id) AS pos, count(*) OVER () AS size FROM replay WHERE games >= 5))"""
#: Greedy choice over a champion's slots: what is first in a slot is not shown in later ones.
_SELECTION = f""", bs AS (SELECT champion, slot, list(item_id ORDER BY games DESC, item_id) AS ids, list(games ORDER BY games DESC, item_id) AS gs FROM {_SLOTS} GROUP BY 1, 2),
g AS (
    SELECT DISTINCT champion, 0 AS slot, CAST([] AS INTEGER[]) AS taken, CAST([] AS INTEGER[]) AS shown FROM bs
    UNION ALL
    SELECT champion, slot + 1, CASE WHEN len(free) > 0 THEN list_append(taken, free[1]) ELSE taken END, free[:3]
    FROM (SELECT g.*, coalesce(list_filter(bs.ids, lambda x: NOT list_contains(g.taken, x)), []) AS free FROM g LEFT JOIN bs ON bs.champion = g.champion AND bs.slot = g.slot + 1) WHERE slot < 6)
SELECT g.champion, CAST(g.slot AS INTEGER) AS slot, CAST(k AS INTEGER) AS choice, g.shown[k] AS item_id, bs.gs[list_position(bs.ids, g.shown[k])] AS games
FROM g JOIN bs ON bs.champion = g.champion AND bs.slot = g.slot, range(1, 4) t(k) WHERE k <= len(g.shown)"""


_PAIRS = "(SELECT champion, a, b, category, " + _C4 + " FROM combos GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10)"
_PICKED = f"(SELECT champion, augment_id, {_RARITY} AS rarity, {_C4} FROM augs GROUP BY 1, 2 HAVING count(*) >= 5)"
_NOT_STAT = "NOT coalesce(opener IN (3, 7, 11, 19), false)"
#: Each part of a champion document: name, fields, rows.
_PARTS = [
    ("totals", "games, top1_wins, top3_wins, placement_sum, m", f"{_CHAMPIONS} CROSS JOIN (SELECT count(DISTINCT match_id) AS m FROM cur)"),
    ("all_items", "item_id, games", f"{_ALL_ITEMS} WHERE games >= 5"),
    ("anvil_items", "item_id, games", f"{_ANVIL_ITEMS} WHERE games >= 3"),
    ("all_augments", "augment_id, games", _PICKED),
    ("anvil_augments", "augment_id, games", "(SELECT champion, augment_id, count(*) AS games FROM (SELECT champion, unnest(augments) AS augment_id FROM anvil WHERE run) WHERE augment_id NOT IN (5, 13) GROUP BY 1, 2 HAVING count(*) >= 3)"),
    ("top_augments", "rarity, position, augment_id, games", f"""(SELECT *, row_number() OVER (PARTITION BY champion, rarity ORDER BY round(score, 9) DESC, augment_id) AS position
        FROM {_scores(_PICKED, 'champion, augment_id, rarity', 'champion, rarity')}) WHERE position <= 5"""),
    ("top_prismatic", "position, item_id, games", f"{_PRISMATIC} WHERE position <= 6"),
    ("anvil_top_prismatic", "position, item_id, games", f"""(SELECT *, row_number() OVER (PARTITION BY champion ORDER BY round(score, 9) DESC, item_id) AS position FROM
        {_scores(_ANVIL_ITEMS, 'champion, item_id', 'champion', 'tier_placement', 'tier_top1', 'tier_top3')}) WHERE position <= 3"""),
    ("item_build", "slot, choice, item_id, games", "selection"),
    ("anvil", "games, top1_wins, top3_wins, stat_games, stat_top3_wins, other_games, other_top3_wins",
     f"(SELECT champion, {_C4}, {_if(f'NOT ({_NOT_STAT})', 'stat_')}, {_if(_NOT_STAT, 'other_')} FROM anvil WHERE run GROUP BY 1)"),
    ("all_combos", "category, position, a, b, games, top1_wins, top3_wins, placement_sum", "pairs WHERE position <= 60"),
    ("champion_combos", "category, position, a, b, games", "pairs WHERE position <= 10"),
]
_DOCUMENTED = f""", selection AS ({_SELECTION[_SELECTION.index('SELECT g.champion'):]}),
pairs AS (SELECT c.*, row_number() OVER (PARTITION BY c.champion, c.category ORDER BY round(s.score, 9) DESC, c.a, c.b) AS position
    FROM {_PAIRS} c JOIN {_scores(_PAIRS, 'champion, a, b, category', 'champion, category')} s USING (champion, a, b))
""" + "\nUNION ALL ".join(f"SELECT champion, concat_ws(',', '{name}', {fields}) AS line FROM {rows}" for name, fields, rows in _PARTS)


#: Statistics that are SQL functions as well.
_CALLED = ("champion_stats", "champion_rates", "champion_placement_counts", "augment_stats", "champion_augment_stats", "augment_timing", "comp_archetypes",
           "patch_match_count", "patch_options", "site_totals", "leaderboard_top", "player_rank", "find_player")


#: Bisection of all boundaries: an unknown version counts as before.
_BISECTED = """,
m AS (SELECT row_number() OVER (ORDER BY mn) - 1 AS i, mn, CASE WHEN mn % 3 <> 1 THEN patch END AS patch FROM matches),
k AS (SELECT *, TIMESTAMP '2026-01-01 00:00:00' + to_minutes(CAST(7 * mn AS BIGINT)) AS at, coalesce(CAST(split_part(patch, '.', 1) AS INTEGER) * 1000 + CAST(split_part(patch, '.', 2) AS INTEGER), 0) AS p FROM m),
b AS (
    SELECT target, CAST(16000 + minor AS BIGINT) AS want, CAST(0 AS BIGINT) AS lo, (SELECT count(*) FROM k) AS hi FROM (VALUES ('16.9', 9), ('16.18', 18), ('16.19', 19), ('16.20', 20)) t(target, minor)
    UNION ALL
    SELECT target, want, CASE WHEN k.p >= want THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN k.p >= want THEN (lo + hi) // 2 ELSE hi END
    FROM b JOIN k ON k.i = (lo + hi) // 2 WHERE lo < hi)
SELECT target AS patch, lo AS position, strftime(x.at, '%Y-%m-%d %H:%M:%S') AS starts_at, strftime(y.at, '%Y-%m-%d %H:%M:%S') AS previous_at, CAST(round(epoch(x.at - y.at) / 60) AS BIGINT) AS minutes
FROM b JOIN k x ON x.i = lo LEFT JOIN k y ON y.i = lo - 1 WHERE lo = hi"""


def oracle_sql() -> dict[str, str]:
    again = _BASE.replace("WITH o AS", "WITH RECURSIVE o AS", 1).rstrip()
    out = {"build_selection": again + _USABLE + _SELECTION, "tier_letters": again + _LETTERS, "rating_replay": f"{again}{_SEASON}\n{_REPLAYED}", "rating_ladder": f"{again}{_SEASON}\n{_LADDER}",
           "patch_boundary_search": again + _BISECTED,
           "champion_document_parts": again + _USABLE + _ACQ_ANVIL + _SELECTION[: _SELECTION.index("SELECT g.champion")].rstrip() + _DOCUMENTED}
    for name, body in _BODIES.items():
        base = _BASE.rstrip() + (_USABLE if "usable" in body else "") + (_ACQ_ANVIL if "acq_anvil" in body else "") + (_CHOSEN if "chosen" in body else "")
        out[name] = f"{base}{'' if body.startswith(',') else chr(10)}{body}"
    out |= _TABLES
    return out | {f"sql_{name}": out[name] for name in _CALLED}
