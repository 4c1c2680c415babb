"""Canonical tables shared by every operator, as DDL schema strings.

``lvl`` is the index of a level, root first.  A label is only unique inside its
level, so every key that names a label is the pair ``(lvl, label)``.
"""

# The level names used by the text formats, root first.
LEVELS = ("class", "order", "family", "genus", "species")
ANCESTOR_LEVELS = ("kingdom", "phylum")
ALL_LEVELS = ANCESTOR_LEVELS + LEVELS

SCORES = "id STRING, lvl INT, label BIGINT, ord INT, prob DOUBLE"
EDGES = "lvl INT, parent BIGINT, child BIGINT, ord BIGINT"
TRAINED = "lvl INT, pos INT, label BIGINT"
ENCODINGS = "lvl INT, label BIGINT, taxon_id BIGINT"
NAMES = "lvl INT, label BIGINT, name STRING"
TRUTH = "id STRING, lvl INT, label BIGINT"
PATHS = "id STRING, start_lvl INT, path ARRAY<STRUCT<lvl: INT, label: BIGINT, prob: DOUBLE>>, conf DOUBLE"
EPOCHS = "run STRING, epoch INT, phase STRING, loss DOUBLE, acc DOUBLE"
CLASS_ACCURACY = "run STRING, class STRING, num_tp BIGINT, num_total BIGINT"
