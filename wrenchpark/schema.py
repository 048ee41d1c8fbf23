"""Table schemas, catalog seeds and column sets of the work-order model.

English names are used throughout; the source system's Spanish terms are kept
only where they are data (status names, audit actions, attachment groups).
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values that must equal the source system's (seed rows, labels) ---
# Status seeds in id order, then the status added by the migration.
STATUS_SEED = [(1, "Pendiente"), (2, "En curso"), (3, "Cerrado"), (4, "En espera")]
# Job type seeds in id order.
TYPE_SEED = [(1, "Urgente"), (2, "Mantención"), (3, "Reparación"), (4, "Compra"), (5, "Instalación")]
# Location seeds in id order.
LOCATION_SEED = [
    (1, "Administración"), (2, "Comercial"), (3, "RRHH"), (4, "Casino"), (5, "Sala de juegos"),
    (6, "Of. Servicios"), (7, "Of. Tableros"), (8, "Taller Servicios"), (9, "Taller Tableros"),
    (10, "Almacen"), (11, "Of. De Almacen"), (12, "Operaciones"), (13, "Porteria"), (14, "Of. Pinturas"),
    (15, "Bod, Pinturas"), (16, "Patio 1"), (17, "Patio 2"), (18, "Estacionamiento P1"),
    (19, "Estacionamiento P2"),
]
# Priority seeds in id order.
PRIORITY_SEED = [(1, "Alta"), (2, "Media"), (3, "Baja")]
CLOSED_STATUS = "cerrado"              # compared in lower case
NO_PRIORITY_LABEL = "Sin prioridad"    # priority breakdown label for NULL
NO_PROVIDER_LABEL = "—"                # provider totals label for blank / NULL (em dash)
ATTACHMENT_GROUPS = ["antes", "despues", "evidencia"]
ATTACHMENT_GROUP_LIMITS = {"antes": 2, "despues": 2, "evidencia": 20}
ALLOWED_MIME = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp"}
DEFAULT_EXTENSION = "bin"
UPLOAD_MAX_BYTES = 5 * 1024 * 1024
AUDIT_ACTIONS = ["CREADO", "ADJUNTO_SUBIDO", "EDITADO", "ESTADO_CAMBIADO",
                 "COMENTARIO_AGREGADO", "COMENTARIO_ELIMINADO", "ADJUNTO_ELIMINADO"]
# Text limits of the job table (NVARCHAR sizes) used by the contract check.
TEXT_LIMITS = {"created_by_name": 100, "created_by_email": 150, "provider": 150,
               "purchase_order": 50, "requested_by": 100, "owner_name": 100, "owner_email": 150}
DESCRIPTION_MAX = 4000
PREVIEW_CHARS = 200
USER_AGENT_MAX = 250
# Spreadsheet headings of the labelled export, in column order.
EXPORT_LABELS = [
    ("id", "ID"), ("created_at", "Fecha creación"), ("status", "Estado"), ("job_type", "Tipo"),
    ("location", "Ubicación"), ("priority", "Prioridad"), ("provider", "Proveedor"),
    ("description", "Descripción"), ("purchase_order", "OC"), ("net_value", "Valor neto"),
    ("requested_by", "Solicitado por"), ("repair_date", "Fecha reparación"),
    ("due_date", "Fecha objetivo"), ("owner_name", "Resp. nombre"), ("owner_email", "Resp. correo"),
    ("days_open", "Días abierto"), ("overdue", "Atrasado"),
]
# --- end of fixed values ---

CATALOG = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
])

JOB = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("created_by_name", T.StringType(), True),
    T.StructField("created_by_email", T.StringType(), True),
    T.StructField("provider", T.StringType(), True),
    T.StructField("description", T.StringType(), False),
    T.StructField("location_id", T.IntegerType(), False),
    T.StructField("purchase_order", T.StringType(), True),
    T.StructField("net_value", T.DecimalType(12, 2), True),
    T.StructField("type_id", T.IntegerType(), False),
    T.StructField("status_id", T.IntegerType(), False),
    T.StructField("repair_date", T.DateType(), True),
    T.StructField("requested_by", T.StringType(), True),
    T.StructField("closed_at", T.TimestampNTZType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("priority_id", T.IntegerType(), True),
    T.StructField("due_date", T.DateType(), True),
    T.StructField("owner_name", T.StringType(), True),
    T.StructField("owner_email", T.StringType(), True),
])
JOB_COLUMNS = [f.name for f in JOB.fields]
# Columns added by the migration; a table without them is read with NULLs.
MIGRATION_COLUMNS = ["priority_id", "due_date", "owner_name", "owner_email"]
REQUIRED_COLUMNS = [c for c in JOB_COLUMNS if c not in MIGRATION_COLUMNS]

ATTACHMENT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("job_id", T.LongType(), False),
    T.StructField("group", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("original_name", T.StringType(), True),
    T.StructField("uploaded_at", T.TimestampNTZType(), True),
])

COMMENT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("job_id", T.LongType(), False),
    T.StructField("comment", T.StringType(), False),
    T.StructField("author_name", T.StringType(), True),
    T.StructField("author_email", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

AUDIT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("job_id", T.LongType(), False),
    T.StructField("action", T.StringType(), False),
    T.StructField("detail", T.StringType(), True),
    T.StructField("actor_name", T.StringType(), True),
    T.StructField("actor_email", T.StringType(), True),
    T.StructField("ip", T.StringType(), True),
    T.StructField("user_agent", T.StringType(), True),
    T.StructField("logged_at", T.TimestampNTZType(), False),
])

# Search column sets: the list searches four columns, the report seven (K15).
LIST_SEARCH_COLS = ["description", "provider", "purchase_order", "requested_by"]
REPORT_SEARCH_COLS = LIST_SEARCH_COLS + ["created_by_name", "created_by_email", "notes"]

# Columns of an incoming record (all text, as a form posts them).
INCOMING_TEXT_COLS = ["description", "location_id", "type_id", "status_id", "net_value",
                      "created_by_name", "created_by_email", "repair_date", "priority_id",
                      "due_date", "owner_name", "owner_email", "provider", "purchase_order",
                      "requested_by", "notes"]
