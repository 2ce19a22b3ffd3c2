"""Values that must be equal to those of the model and its file formats.

Fixed values: tokens, prompt, limits, extensions, step names and messages.
They are data, not logic.
"""

# Model output markup
EOS_TOKEN = "<｜end▁of▁sentence｜>"
REF_PATTERN = r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
IMAGE_LABEL = "image"
TITLE_LABEL = "title"
COORDINATE_RANGE = 999
PAGE_SPLIT = "\n<--- Page Split --->"

# prompt
IMAGE_PLACEHOLDER = "<image>"
DEFAULT_PROMPT = "<image>\n<|grounding|>Convert the document to markdown."

# Page geometry
BASE_SIZE = 1024
TILE_SIZE = 768
PATCH_SIZE = 16
DOWNSAMPLE_RATIO = 4
MIN_TILES = 2
MAX_TILES = 6
POINTS_PER_INCH = 72
DEFAULT_DPI = 144

# limits
MAX_MODEL_LEN = 8192
DEFAULT_BATCH_PAGES = 128
DEFAULT_MAX_WAIT_MS = 150

# Repetition check, (n-gram size, window) per setting
REPETITION_SETTINGS = {"service": (20, 50), "image": (20, 90), "eval": (40, 90)}
REPETITION_WHITELIST = (128821, 128822)

# Accepted document extensions
DOCUMENT_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")

# Timing steps reported for every request
TIMING_STEPS = (
    "request_body",
    "pdf_render_cpu",
    "image_decode_cpu",
    "cpu_preprocess",
    "gpu_queue_wait",
    "gpu_generate",
    "postprocess_cpu",
    "response_build",
)
UNACCOUNTED_STEP = "unaccounted"
UNACCOUNTED_MIN_MS = 0.5

# messages
ZERO_PAGES_ERROR = "document produced zero pages"
UNKNOWN_ERROR = "unknown error"
INVALID_JSON_ERROR = "Invalid JSON body."
NO_IMAGES_ERROR = "No images provided."
EMPTY_IMAGE_ERROR = "Empty request body. Send raw image bytes."
EMPTY_PDF_ERROR = "Empty request body. Send raw PDF bytes."
COUNT_MISMATCH_ERROR = "Model returned {outputs} outputs for {inputs} inputs."
# Text of our own: page results found, and pages of the document.
MISSING_PAGES_ERROR = "%d of %d pages"
