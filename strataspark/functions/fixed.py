"""Results depend on them being exactly these."""

# modality patterns of feature types (case-insensitive)
RNA_PATTERN = "GEX|Gene Expression|RNA"
ADT_PATTERN = "ADT|Antibody|Protein"

# tolerance of a recovered count: |q - round(q)| against abs + rel * round(q)
COUNT_TOL_ABS = 1e-3
COUNT_TOL_REL = 4e-7

# evidence field
FIELD_STEPS = 4
FIELD_RETENTION = 0.82
FIELD_DIFFUSION = 0.16
FIELD_SOURCE_SCALE = 1.0
FIELD_FORWARD_WEIGHT = 1.0
FIELD_FEEDBACK_WEIGHT = 0.15
CONTRADICTION_FACTOR = 0.5

# linear response
RHO_TOLERANCE = 0.1
MIN_COSINE = 0.9
FLOOR_MULTIPLE = 3.0

# scopes in the order of what each may use; leakage statuses from best to worst; kinds of contrast
SCOPE_ORDER = ["frozen", "train", "units", "own"]
LEAK_ORDER = {"pass": 0, "flag": 1, "unknown": 2, "fail": 3}
CONTRAST_KINDS = ["donor", "batch", "study", "disease", "condition"]
MIN_UNITS = 10
MIN_FIT_ROWS = 50
MIN_SIDE_ROWS = 20

# labels of comparisons, contrasts and marks
NO_ADDED_LOSS = "no added loss"
LOSS_UNRESOLVED = "loss no longer resolved"
NOT_ATTAINABLE = "not attainable"
CONFIRMATORY = "confirmatory possible"
REDUCES_BELOW_MARGIN = "reduces the loss by less than the margin"
REDUCES = "reduces the loss"
ADDS = "adds to the loss"
DOES_NOT_REDUCE = "does not reduce the loss"
STEP_CONFIRMED = "located step confirmed"
STEP_NOT_CONFIRMED = "located step not confirmed"
MARK_NOT_HERE = "cannot be put on these rows"
MARK_NOT_SUPPORTED = "not supported"
MARK_BETWEEN = "between the marks"
