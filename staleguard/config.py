"""Fixed values the results depend on.

These constants must equal the values used by the analyses this toolkit
reproduces; they are stated plainly here, in one place.
"""

# --- fixed values -----------------------------------------------------------
# ASCII punctuation removed by text normalisation (Python's string.punctuation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Characters removed by Python's str.strip() for ASCII text.
PY_WHITESPACE = " \t\n\r\x0b\x0c"
# Chunk splitting: separators tried in order, chunk size and overlap in characters.
SPLIT_SEPARATORS = ["\n\n", "\n", " ", ""]
CHUNK_SIZE = 512
CHUNK_OVERLAP = 128
# Context delimiter for generation prompts, and the delimiter used for scoring.
CONTEXT_DELIMITER = "\n\n-- new chunk --\n"
SCORING_DELIMITER = "\n"
# Derived ids: prefix + original id zero-filled to 5 digits.
ID_ZERO_FILL = 5
# Creation dates from id prefix, tested in this order; anything else is the default.
PREFIX_DATES = [("400", "2010-01-01"), ("300", "2015-01-01"), ("100", "2005-01-01")]
DEFAULT_DATE = "2000-01-01"
# Threshold sweep: recall target that stops the sweep and the grid step.
SWEEP_TARGET_RECALL = 0.99
SWEEP_STEP = 0.05
# Domains in round-robin sampling order.
SAMPLING_DOMAINS = ["Finance", "Medical", "Law"]
# English stop words: the default list of Spark ML's StopWordsRemover.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()
# --- end fixed values -------------------------------------------------------

# Parameters chosen for the bundled test tables (see README "Test tables").
VECTOR_RELATION_THRESHOLD = 0.75
