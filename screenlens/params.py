"""Thresholds and limits whose exact value decides the result."""

# Change signals and event detection (seconds, shares, 0..255 gray levels)
PIXEL_DELTA = 25.0
ROW_CHANGED_SHARE = 0.02
HOT_ROW_MULTIPLE = 4.0
HOT_ROW_FLOOR = 0.005
MAX_BAND_SHARE = 0.20
MIN_BAND_ROWS = 8
ANCHOR_THRESHOLD = 0.02
RATE_THRESHOLD = 0.0015
CUT_AREA_THRESHOLD = 0.002
ANCHOR_RESET_THRESHOLD = 0.02
CUT_RESET_THRESHOLD = 0.02
RATE_SETTLE_THRESHOLD = 0.0015
RATE_PEAK_MULTIPLE = 8.0
MERGE_WINDOW = 0.5
SETTLE_LIMIT = 1.0
BLANK_AREA = 0.001
PAIR_CHANGED_BELOW = 0.93
STABLE_BELOW = 0.97
NEIGHBOUR_RATIO = 2.0

# Lookups
FRAME_AT_SLACK = 0.001
FRAME_INDEX_SLACK = 0.05
MARK_SLACK = 0.05
MARK_KINDS = ["frame", "rejected", "screen", "flag", "requested", "transition", "segment"]
MARK_KINDS_JUMPED = ["frame", "rejected", "flag", "requested"]

# Subtitles
MIN_CUES = 5
MIN_COVERAGE = 0.30
MAX_ROLLUP = 0.30
SPAN_OVERHANG = 1.10
SPAN_SLACK = 5.0
SMI_MAX_CUE = 7.0
OPEN_CUE_SECONDS = 2.0
SUBTITLE_FORMATS = {"srt": "srt", "vtt": "vtt", "webvtt": "vtt", "smi": "smi", "sami": "smi"}
FORMAT_ORDER = ["srt", "vtt", "smi"]
SOURCE_ORDER = ["sidecar", "embedded"]
SOURCE_KINDS = ["explicit", "sidecar", "embedded", "whisper", "none"]
DISPOSITION_DEFAULT = 0x01
DISPOSITION_FORCED = 0x40
DISPOSITION_HEARING_IMPAIRED = 0x80

# Images
READ_LONG_EDGE = 768
TOKEN_LONG_EDGE = 1568
PIXELS_PER_TOKEN = 750
TOKEN_RULE = "width x height / 750 tokens once the longer side is at most 1568 px"
DARK_LUMA = 5.0

# Ground truth
FLAG_DEDUPE = 0.25
FLAG_TOGGLE = 0.6

# Origins
INFO_KEYS = ["webpage_url", "original_url", "url"]
CONTAINER_KEYS = ["purl", "comment", "www"]

# Reviews
REVIEW_MAX_BYTES = 1024 * 1024
REVIEW_SCHEMA = "screenlens/review@1"
REVIEW_BEGIN = "<!-- screenlens:review BEGIN -->"
REVIEW_END = "<!-- screenlens:review END -->"

# Stages in the order they must run
STAGES = ["split", "transcribe", "frames"]
