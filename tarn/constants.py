"""Texts, limits and patterns that results must reproduce exactly."""

# Objects
HIDDEN_MARKER = "_SUCCESS"
HIDDEN_SUFFIX = ".crc"
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg")
UPLOAD_EXTENSIONS = ("csv", "txt", "png", "jpg", "jpeg")
PART_MARKER = "part-"
PARQUET_SUFFIX = ".parquet"
ROOT_FOLDER = "/"
DATASET_LABEL_PREFIX = "📁 "
DATASET_LABEL_SUFFIX = " (Dataset Spark)"

# Preview record
UNKNOWN_UPLOADER = "Desconhecido"
INFO_SIZE = "0 B"
INFO_MODIFIED = "-"
INFO_UPLOADER = "Apache Spark"
INFO_TEXT = "Metadado do Apache Spark."
NO_PREVIEW_TEXT = "Pré-visualização não disponível."
PREVIEW_ERROR_PREFIX = "Erro ao gerar sample: "
TIMESTAMP_FORMAT = "dd/MM/yyyy HH:mm:ss"
PREVIEW_ROWS = 10
INTERNAL_STORE_URL = "http://minio:9000"
PUBLIC_STORE_URL = "http://localhost:9000"

# Workspaces
EDITOR_PREFIX = "vscode-"
WORKER_PREFIX = "spark-worker-"
MASTER_MARKER = "spark-master"
ROLES = ("vscode", "spark-worker")
RUNNING = "running"
NANO = 1_000_000_000
DEFAULT_CORES = 2.0
MAX_PERCENT = 100.0
IDLE_SECONDS = 900
HISTORY_POINTS = 20
METRICS_SECONDS = 3
# A container that has sent no sample in ten refreshes is taken as gone.
PRESENT_SECONDS = 10 * METRICS_SECONDS

# Profiles: name, cores, editor GB, worker GB, free cores needed, free GB needed
PROFILES = (
    ("standard", 2, 1, 3, 2, 4),
    ("extreme", 6, 2, 6, 6, 8),
)

# Applications
RECENT_COMPLETED = 10
JOB_PREFIX = "job_"
SCRIPT_SUFFIX = ".py"
PAUSED = "Pausado"
GOOD_STATE = "FINISHED"
BAD_STATES = ("FAILED", "KILLED")
DRIVER_LINK_PATTERN = r'href="(http://[^"]+)">(Application Detail UI|Application UI)</a>'
