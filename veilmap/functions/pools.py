"""Value lists for fake names, free to choose: nothing depends on their content."""

# Words of fake host names, by kind of thing.
HOST_WORDS = (
    "ASH", "BEECH", "BIRCH", "CEDAR", "ELM", "HAZEL", "LARCH", "MAPLE", "OAK", "PINE", "ROWAN", "SPRUCE", "WILLOW", "YEW",
    "BADGER", "BEAVER", "HERON", "LYNX", "MARTEN", "OTTER", "PLOVER", "RAVEN", "STOAT", "SWIFT", "TERN", "WREN",
    "BASALT", "CHALK", "FLINT", "GNEISS", "GRANITE", "MARBLE", "SHALE", "SLATE", "TUFF",
    "BROOK", "DELL", "FJORD", "GLEN", "HEATH", "LAGOON", "MARSH", "MEADOW", "MOOR", "RIDGE", "TARN", "VALE",
)

# Stems of fake account names, numbered from 001 (the first) or 01 (others).
ACCOUNT_STEMS = ("user", "clerk", "agent", "guest", "staff", "desk", "team", "shift")

# Fake domains, all below names reserved for examples and tests.
FAKE_DOMAINS = (
    "north.example", "south.example", "east.example", "west.example", "upper.test", "lower.test",
    "inner.test", "outer.test", "first.invalid", "second.invalid",
)
