"""Engine parameters (one frozen dataclass).

The defaults reproduce the reference engine's default configuration. The
fixed values below must stay equal to the reference's for equal results.
"""

from __future__ import annotations

from dataclasses import dataclass


# --- fixed values (must equal the reference's defaults) ---------------------
# event names that make an item "seen" for a user (black-listed when unseen_only)
SEEN_EVENTS = ("own", "scrap")
# event names whose latest occurrences define a user's recent items
SIMILAR_EVENTS = ("view", "play", "own", "rate", "scrap")
# how many latest events make up the recent list
RECENT_EVENTS_LIMIT = 10
# affinity weights per event: view 1.0, play 5.0, own 3.0, scrap 2.0, cancelled scrap 0.0
VIEW_WEIGHT = 1.0
PLAY_WEIGHT = 5.0
OWN_WEIGHT = 3.0
SCRAP_WEIGHT = 2.0
CANCELLED_SCRAP_WEIGHT = 0.0
# a rating counts as (rating - 2.75)
RATING_CENTER = 2.75
# popularity: every view and every play counts 1.0, every scrap +2.0, every cancel -2.0
POP_VIEW_WEIGHT = 1.0
POP_PLAY_WEIGHT = 1.0
POP_SCRAP_WEIGHT = 2.0
POP_CANCEL_WEIGHT = -2.0
# overlap score: 5.0 per cosmetic a user owns that a content mentions
OVERLAP_WEIGHT = 5.0
# implicit ALS: rank 10, 10 iterations, lambda 0.01, alpha 1.0, seed 3
ALS_RANK = 10
ALS_ITERATIONS = 10
ALS_LAMBDA = 0.01
ALS_ALPHA = 1.0
ALS_SEED = 3
# item kinds and the entity type / id that carries unavailable items
CONTENT = "content"
COSMETIC = "cosmetic"
CONSTRAINT_ENTITY_TYPE = "constraint"
UNAVAILABLE_ENTITY_ID = "unavailableItems"
# both spellings of a cancelled scrap are honoured by default
CANCEL_SCRAP_NAMES = ("cancel_scrap", "cancle_scrap")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """All knobs of the engine; defaults follow the reference's engine file."""

    unseen_only: bool = True
    seen_events: tuple[str, ...] = SEEN_EVENTS
    similar_events: tuple[str, ...] = SIMILAR_EVENTS
    # per item_type override of similar_events (off by default)
    similar_events_by_type: dict[str, tuple[str, ...]] | None = None
    recent_limit: int = RECENT_EVENTS_LIMIT
    # target types looked up for seen / recent events; ('item',) is the literal,
    # always-empty behaviour of the reference
    target_types: tuple[str, ...] = (CONTENT, COSMETIC, "item")
    cancel_names: tuple[str, ...] = CANCEL_SCRAP_NAMES

    view_weight: float = VIEW_WEIGHT
    play_weight: float = PLAY_WEIGHT
    own_weight: float = OWN_WEIGHT
    scrap_weight: float = SCRAP_WEIGHT
    cancelled_scrap_weight: float = CANCELLED_SCRAP_WEIGHT
    rating_center: float = RATING_CENTER
    pop_view_weight: float = POP_VIEW_WEIGHT
    pop_play_weight: float = POP_PLAY_WEIGHT
    pop_scrap_weight: float = POP_SCRAP_WEIGHT
    pop_cancel_weight: float = POP_CANCEL_WEIGHT
    overlap_weight: float = OVERLAP_WEIGHT

    rank: int = ALS_RANK
    iterations: int = ALS_ITERATIONS
    reg: float = ALS_LAMBDA
    alpha: float = ALS_ALPHA
    seed: int | None = ALS_SEED
    als_blocks: int | None = None     # None: the cluster's default parallelism

    # Optional score adjustments, {'popular' | 'known' | 'similar': Column -> Column},
    # applied before the positive-score filter and the top-N
    score_hooks: dict | None = None

    # the overlap scorer honours only the request's own black list (literal);
    # True applies seen + unavailable items to it too
    blacklist_all_scorers: bool = False

    # --- execution knobs (no effect on results) ---
    # a requests / signatures side is broadcast only below this row count;
    # above it the pair join is salted over the item side instead
    broadcast_rows: int = 200_000
    # salt buckets for the item_type join
    salt_buckets: int = 16
    # characters of a gram of the name index; searches without a term that long are joined on the item type
    gram_size: int = 3
    # a join key with more result rows than this is laid out over several tasks
    hot_key_pairs: int = 4_000_000
    # factor scoring: "blocks" (matrix blocks, default) or "pairs" (one row per pair, for tests)
    scoring: str = "blocks"
    # per cell of the blocked scorer: shuffle copies are R x (C / block_items) + C x (R / block_requests)
    block_requests: int = 65_536
    block_items: int = 50_000


DEFAULT = Params()
