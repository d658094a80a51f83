"""Fixed values that must equal the source application's for identical results.

Everything under "FIXED VALUES" is stated as data, in natural order.  Larger
tables (the accent fold, the whitespace class) are generated from a rule at
import time instead of being listed.
"""

from __future__ import annotations

import sys
import unicodedata

# ───────────────────────────── FIXED VALUES ─────────────────────────────────

# Header aliases of a delimited export (unaccented) -> the sheet's headers.
HEADER_ALIASES = {
    "Fecha Asistencia Tecnica TMERT 2026*": "Fecha Asistencia Técnica TMERT 2026*",
    "Region": "Región",
    "Direccion CT": "Dirección CT",
    "N de trabajadores(as) a evaluar 2026 N hombres": "N° de trabajadores(as) a evaluar 2026 N° hombres",
    "N de trabajadores(as) a evaluar 2026 N mujeres": "N° de trabajadores(as) a evaluar 2026 N° mujeres",
}

# Plan sheet headers (after alias renaming).
H_PLANNED = "Fecha Asistencia Técnica TMERT 2026*"
H_REGION = "Región"
H_SPECIALIST = "Ergonomo"
H_ACCOUNT = "Gerencia - Cuenta Nacional"
H_HOLDING = "Holding"
H_EMPLOYER = "Nombre Empleador"
H_CENTER_ID = "ID-CT"
H_CENTER_NAME = "Nombre CT"
H_ADDRESS = "Dirección CT"
H_COMMUNE = "Comuna CT"
H_COMMUNE_2 = "Comuna CT2"
H_MEN = "N° de trabajadores(as) a evaluar 2026 N° hombres"
H_WOMEN = "N° de trabajadores(as) a evaluar 2026 N° mujeres"
# Multi-valued case columns -> our names.
CASE_COLUMNS = {
    "folios": "case_ids",
    "ocupaciones": "occupations",
    "tareas": "tasks",
    "observaciones": "notes",
    "cie10": "icd10",
    "diagnosticos": "diagnoses",
    "segmentos": "segments",
}

# Follow-up sheet headers -> our names.
H_VISIT_STATUS = "Estado AT"
H_GOAL = "Meta 5 Cumplida"
PILLAR_HEADERS = [
    "Pilar 1 - Difusión",
    "Pilar 2 - Capacitación",
    "Pilar 3 - Diseño Cap Pract",
    "Pilar 4 - Prescripción Caract",
]
H_CUTOFF = "_FechaCorte"
FOLLOWUP_RENAMES = {
    "Región": "region",
    "Ergonomo": "specialist",
    "Gerencia - Cuenta Nacional": "account",
    "Holding": "holding",
    "Nombre Empleador": "employer",
    "ID-CT": "center_id",
    "Nombre CT": "center_name",
    "Dirección CT": "address",
    "Comuna CT": "commune",
    "Estado AT": "visit_status",
    "Meta 5 Cumplida": "goal_met",
    "Pilar 1 - Difusión": "pillar_1",
    "Pilar 2 - Capacitación": "pillar_2",
    "Pilar 3 - Diseño Cap Pract": "pillar_3",
    "Pilar 4 - Prescripción Caract": "pillar_4",
    "Estado Seguimiento Prescripción Caracterización (sigeco)": "prescription_followup_status",
    "Último Profesional Registra (sigeco)": "last_professional",
    "Fecha AT Difusión (real)": "diffusion_date",
    "Fecha AT Capacitación (real)": "training_date",
    "Fecha Prescripción Caracterización (real)": "prescription_date",
    "Fecha Diseño Cap Práctica (real)": "practical_design_date",
    "_FechaCorte": "cutoff_date",
}
# Column-name patterns that type the follow-up sheet.
DATE_NAME_INCLUDE = ["Fecha", "Prescripción"]
DATE_NAME_EXCLUDE = ["Pilar", "Estado"]
BOOL_NAME_INCLUDE = ["Pilar", "Cumplida", "Validado"]

# Flexible booleans: spellings (after upper-casing and trimming) that mean true.
# Every other value, including NULL, is false.
TRUE_SPELLINGS = ["TRUE", "1", "VERDADERO"]

# Defaults for missing values / missing columns.
REGION_NULL = "S/R"
REGION_MISSING = "N/A"
SPECIALIST_DEFAULT = "No Asignado"
ACCOUNT_DEFAULT = "Sin Dato"
HOLDING_DEFAULT = "Sin Dato"
COMMUNE_DEFAULT = "S/D"
NO_DATA = "sin datos"

# Visit status that counts as overdue.
OVERDUE_STATUS = "Pendiente atrasada"

# Month number -> Spanish month name.
MONTH_NAMES_ES = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]

# Anatomical order of body segments (proximal -> distal, right -> left).
SEGMENT_ORDER = [
    "HOMBRO_DER", "HOMBRO_IZQ",
    "CODO_DER", "CODO_IZQ",
    "MUÑECA_DER", "MUÑECA_IZQ",
    "MANO_DER", "MANO_IZQ",
    "DEDOS_DER", "DEDOS_IZQ",
    "PULGAR_DER", "PULGAR_IZQ",
    "CERVICAL",
    "LUMBAR",
]

# Separators of multi-valued cells.
OUTER_SEP = "||"
INNER_SEP = {"tasks": ",", "diagnoses": ",", "occupations": " | ", "segments": ","}
SEGMENT_EXTRA_SEPS = [" "]

# Characters kept by the label normaliser (everything else is deleted).
NORMALIZE_KEEP_CLASS = "a-z0-9 /().-"

# Normaliser parameters.
SIMILARITY_THRESHOLD = 88
PARETO_TOP = 30
PARETO_CUT = 80.0
RANKING_TOP = 10

# Short pillar labels: literal replacements applied in this order.
PILLAR_LABEL_REPLACEMENTS = [
    ("Pilar ", "P"),
    (" - ", ": "),
    (" Cap Pract", " Cap"),
    (" Caract", ""),
]

# Export URL of a spreadsheet link.
SHEET_ID_PATTERN = r"/d/([a-zA-Z0-9_-]+)"
SHEET_GID_PATTERN = r"gid=(\d+)"
SHEET_EXPORT_URL = "https://docs.google.com/spreadsheets/d/{id}/export?format=csv&gid={gid}"

# ─────────────────────────── GENERATED TABLES ───────────────────────────────


def _whitespace_code_points() -> list[int]:
    """Code points Python's ``str.isspace`` accepts (what ``str.strip`` and
    ``re``'s ``\\s`` use)."""
    return [cp for cp in range(sys.maxunicode + 1) if chr(cp).isspace()]


def _ranges(cps: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in cps:
        if out and out[-1][1] == cp - 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def _regex_class(cps: list[int]) -> str:
    """A regex character class accepted by both java.util.regex and RE2."""
    parts = []
    for lo, hi in _ranges(cps):
        parts.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
    return "[" + "".join(parts) + "]"


WHITESPACE_CLASS = _regex_class(_whitespace_code_points())


def _accent_fold_table() -> tuple[str, str]:
    """Lower-case code points whose canonical decomposition, without
    non-spacing marks, is one ASCII letter ``a``-``z`` (``á``->``a``, ``ñ``->``n``).

    Rule-generated; used with ``translate`` so precomposed letters fold
    without a JVM-side Unicode normaliser.  Combining marks that arrive
    already decomposed are removed separately (``\\p{Mn}``).
    """
    src, dst = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if ch.lower() != ch:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch)
                       if unicodedata.category(c) != "Mn")
        if len(base) == 1 and "a" <= base <= "z":
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENT_SRC, ACCENT_DST = _accent_fold_table()

# Spellings that a delimited read takes for a missing cell.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
             "NULL", "NaN", "None", "n/a", "nan", "null"]

# English month names, as free date spellings use them.
MONTH_NAMES_EN = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
                  "November", "December"]

#: Display labels of the visit detail.  Fixed values.
DETAIL_LABELS = {
    "date_text": "Fecha", "region": "Region", "specialist": "Ergónomo", "employer": "Nombre Empleador",
    "center_name": "Centro de Trabajo", "commune": "Comuna", "address": "Dirección", "men": "N° Hombres",
    "women": "N° Mujeres", "total_workers": "Total Trabajadores",
}

# Weekday names, Monday first, as free date spellings use them.
WEEKDAY_NAMES_ES = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]
WEEKDAY_NAMES_EN = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
