"""Publication: all views of the published patches, computed once and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import tiers
from muster.operators import anvil, builds, champions, combos, comps, items, players, stats, views
from muster.sources.fixtures import OPENERS, Season
from muster.sources.snapshots import SnapshotStore

SHARDBLADE = 1007
#: Pairs change slowly and cost the most: those younger than this are kept.
COMBO_HOURS = 24


def combo_views(s: Season, rows: DataFrame, patch: str) -> dict[str, DataFrame]:
    """The best pairs of one patch, of all champions and of each."""
    every = combos.combos(rows, s.ref_items, s.ref_augments, 5)
    own = combos.combos(rows, s.ref_items, s.ref_augments, champions.COMBO_MIN, ("champion",))
    return {f"combos@{patch}": combos.top_combos(every, 200), f"champion_combos@{patch}": combos.top_combos(own, champions.COMBOS_KEPT, ("champion",))}


def patch_views(s: Season, rows: DataFrame, pairs: DataFrame, patch: str) -> dict[str, DataFrame]:
    """Views of one patch by key; ``rows`` are its clean participations, ``pairs`` the best pairs of each champion."""
    matches = views.patch_match_count(rows)
    grid = items.item_acquisitions(rows, s.ref_items)
    free = anvil.with_anvil(rows, s.ref_items)
    found = {
        "champions": stats.champion_rates(rows),
        "champion_tiers": tiers.tier_letters(tiers.tier_scores(stats.champion_stats(rows).drop("placement_counts")).withColumn("view", F.lit("champions")), ["view"], ["champion"]),
        "augments": stats.augment_stats(rows, s.ref_augments),
        "champion_augments": stats.champion_augment_stats(rows, s.ref_augments, 5),
        "augment_timing": stats.augment_timing_swing(stats.augment_timing(rows, s.ref_augments)),
        "items": items.item_adjusted_stats(grid),
        "item_rates": items.item_rates(grid, matches),
        "item_timing": items.item_timing_swing(grid),
        "anvil": anvil.anvil_champions(free),
        "anvil_openers": anvil.anvil_openers(free, OPENERS),
        "comps": comps.comp_rates(rows, s.ref_champions, 20),
        "champion_documents": champions.champion_documents(rows, s.ref_items, s.ref_augments, OPENERS, SHARDBLADE, champions.combo_lists(pairs)),
        "builds": builds.build_selection(builds.build_slots(rows, s.ref_items)),
    }
    return {f"{k}@{patch}": v for k, v in found.items()}


def patch_participants(s: Season, store: SnapshotStore, patch: str) -> DataFrame:
    """Clean rows of ``patch`` as published, else from the season."""
    return store.read(f"participants@{patch}", lambda: views.patch_rows(s, patch))


def publish(s: Season, store: SnapshotStore, min_matches: int = 5) -> list[str]:
    """Computes and stores all views; gives the keys that the store then has."""
    patches = [r["patch"] for r in views.published_patches(s, min_matches).collect()]  # two at most
    kept = {"site", "leaderboard", "ladder", "movers"}
    store.write("site", views.site_totals(s))
    store.write("leaderboard", players.leaderboard_top(s.ratings))
    # all of the ladder: players who have left it go with the old version
    store.write("ladder", s.ratings)
    for patch in patches:
        store.write(f"participants@{patch}", views.patch_rows(s, patch))
        rows = patch_participants(s, store, patch)
        pairs = combo_views(s, rows, patch)
        for key, df in pairs.items():
            if not store.is_fresh(key, COMBO_HOURS):
                store.write(key, df)
        own = f"champion_combos@{patch}"
        found = patch_views(s, rows, store.read(own, lambda: pairs[own]), patch)
        for key, df in found.items():
            store.write(key, df)
        kept |= {*found, *pairs, f"participants@{patch}"}
    if len(patches) == 2:
        now, before = (stats.champion_stats(patch_participants(s, store, p)) for p in patches)
        store.write("movers", stats.champion_movers(now, before))
    store.prune(kept)
    return sorted(k for k in kept if store.has(k))
