"""Presets for the posting domain. Operators take all of this as arguments."""

from __future__ import annotations

# --- Fixed values: these must equal the published rules for equal results. ---

FIELD_ORDER = [
    "posting_unique_id",
    "institution",
    "job_title",
    "posting_start_date",
    "posting_end_date",
    "monthly_salary",
    "number_of_vacancies",
    "contract_type_raw",
    "experience_requirements",
    "academic_profile",
    "specialization",
    "knowledge",
    "competencies",
]

PAGE_LABELS = {
    "number_of_vacancies": "CANTIDAD DE VACANTES",
    "monthly_salary": "REMUNERACIÓN",
    "posting_start_date": "FECHA INICIO DE PUBLICACIÓN",
    "posting_end_date": "FECHA FIN DE PUBLICACIÓN",
    "contract_type_raw": "NÚMERO DE CONVOCATORIA",
}
PAGE_REQUIREMENT_LABELS = {
    "experience_requirements": "EXPERIENCIA",
    "academic_profile": "FORMACIÓN ACADÉMICA",
    "specialization": "ESPECIALIZACIÓN",
    "knowledge": "CONOCIMIENTO",
    "competencies": "COMPETENCIAS",
}
PAGE_LABEL_CLASS = "sub-titulo"
PAGE_REQUIREMENT_CLASS = "sub-titulo-2"
PAGE_VALUE_CLASS = "detalle-sp"
PAGE_TITLE_CLASS = "sp-aviso0"
PAGE_INSTITUTION_CLASS = "sp-aviso"
PAGE_ID_PATTERN = r"N.\s*(\d+)"

CONTRACT_TYPE_PATTERNS = [
    (r"^D\.LEG 1057 - DETERMINADO \(NECESIDAD TRANSITORIA\).*", "D.LEG 1057 DETERMINADO NECESIDAD TRANSITORIA"),
    (r"^D\.LEG 1057 - DETERMINADO \(SUPLENCIA\).*", "D.LEG 1057 DETERMINADO SUPLENCIA"),
    (r"^D\.LEG 1057 - INDETERMINADO.*", "D.LEG 1057 INDETERMINADO"),
    (r"^728.*", "D.LEG 728"),
    (r"^276.*", "D.LEG 276"),
    (r"^DOCENTES UNIVERSITARIOS.*", "DOCENTES UNIVERSITARIOS LEY 30220"),
    (r"^LEY 30220.*", "DOCENTES UNIVERSITARIOS LEY 30220"),
    (r"^LEY 30057.*", "LEY 30057"),
]

CONTRACT_CLASSES = [
    ("D.LEG 1057 DETERMINADO NECESIDAD TRANSITORIA", "D.LEG 1057", "TEMPORARY"),
    ("D.LEG 1057 DETERMINADO SUPLENCIA", "D.LEG 1057", "TEMPORARY"),
    ("D.LEG 1057 INDETERMINADO", "D.LEG 1057", "PERMANENT"),
    ("D.LEG 728", "D.LEG 728", "PERMANENT"),
    ("D.LEG 276", "D.LEG 276", "PERMANENT"),
    ("DOCENTES UNIVERSITARIOS LEY 30220", "LEY 30220", "PERMANENT"),
    ("LEY 30057", "LEY 30057", "PERMANENT"),
]

GENERAL_YEARS_PATTERNS = [
    r"EXPERIENCIA\s+GENERAL[:\s]+.*?(\d+)\s*AÑ[OO]S?",
    r"EXPERIENCIA\s+LABORAL\s+GENERAL[:\s]+.*?(\d+)\s*AÑ[OO]S?",
    r"EXPERIENCIA\s+PROFESIONAL\s+GENERAL[:\s]+.*?(\d+)\s*AÑ[OO]S?",
    r"EXP\s+GENERAL[:\s]+.*?(\d+)\s*AÑ[OO]S?",
    r"GENERAL[:\s]+.*?(\d+)\s*AÑ[OO]S?",
]
SPECIFIC_YEARS_PATTERNS = [
    r"EXPERIENCIA\s+ESPEC[ÍI]FICA[:\s]+.*?(\d+)\s*AÑ[OO]S?",
    r"EXPERIENCIA\s+LABORAL\s+ESPEC[ÍI]FICA[:\s]+.*?(\d+)\s*AÑ[OO]S?",
    r"EXP\s+ESPEC[ÍI]FICA[:\s]+.*?(\d+)\s*AÑ[OO]S?",
    r"ESPEC[ÍI]FICA[:\s]+.*?(\d+)\s*AÑ[OO]S?",
]
TOTAL_YEARS_PATTERNS = [
    r"M[ÍI]NIMA?\s+DE\s+(\d+)\s*AÑ[OO]S?",
    r"NO\s+MENOR\s+[AD]E?\s+(\d+)\s*AÑ[OO]S?",
    r"(\d+)\s*AÑ[OO]S?\s+EN\s+EL\s+SECTOR",
]
PUBLIC_SECTOR_KEYWORDS = [
    "SECTOR PÚBLICO",
    "SECTOR PUBLICO",
    "PÚBLICO",
    "PUBLICO",
    "SECTOR PÚBLICO Y/O PRIVADO",
    "SECTOR PUBLICO Y/O PRIVADO",
]
PRIVATE_SECTOR_KEYWORDS = [
    "SECTOR PRIVADO",
    "PRIVADO",
    "SECTOR PÚBLICO Y/O PRIVADO",
    "SECTOR PUBLICO Y/O PRIVADO",
]
NO_EXPERIENCE_KEYWORDS = ["SIN EXPERIENCIA", "NO REQUIERE EXPERIENCIA"]

# (keyword, search levels, level name, thesis required), in matching order.
ACADEMIC_LEVELS = [
    ("TITULO PROFESIONAL", [6], "Profesional Universitario", 1),
    ("TITULO UNIVERSITARIO", [6], "Profesional Universitario", 1),
    ("PROFESIONAL TECNICO", [3, 4, 5], "Técnico", 0),
    ("AUXILIAR TECNICO", [3, 4, 5], "Técnico", 0),
    ("TITULO TECNICO", [3, 4, 5], "Técnico", 0),
    ("SECUNDARIA COMPLETA", [], "Secundaria", 0),
    ("LICENCIADO", [6], "Profesional Universitario", 1),
    ("INGENIERO", [6], "Profesional Universitario", 1),
    ("BACHILLER", [6], "Profesional Universitario", 0),
    ("EGRESADO", [6], "Profesional Universitario", 0),
    ("TITULADO", [6], "Profesional Universitario", 1),
    ("TECNICO", [3, 4, 5], "Técnico", 0),
    ("MAESTRIA", [7], "Maestría", 1),
    ("DOCTORADO", [8], "Doctorado", 1),
]
RELATED_FIELDS_KEYWORDS = ["AFINES", "CARRERAS AFINES", "SIMILARES"]
COLEGIADO_KEYWORDS = ["COLEGIADO"]
HABILITADO_KEYWORDS = ["HABILITADO"]
MULTIPLE_OPTIONS_KEYWORDS = [" O ", " Y/O "]

TIER_LABELS = {"E": "Nacional", "R": "Regional", "M": "Municipal"}

PROGRAM_COLUMNS = [
    "campo_amplio_codigo",
    "campo_amplio_nombre",
    "campo_especifico_codigo",
    "campo_especifico_nombre",
    "campo_detallado_codigo",
    "campo_detallado_nombre",
    "programa_codigo",
    "programa_nombre",
    "codigo_campo_programa",
    "codigo_campo_programa_nivel",
]
INSTITUTION_COLUMNS = [
    "EJECUTORA",
    "EJECUTORA_NOMBRE",
    "NIVEL_GOBIERNO",
    "NIVEL_GOBIERNO_NOMBRE",
    "SECTOR",
    "SECTOR_NOMBRE",
    "PLIEGO",
    "PLIEGO_NOMBRE",
    "SEC_EJEC",
    "DEPARTAMENTO_EJECUTORA",
    "DEPARTAMENTO_EJECUTORA_NOMBRE",
    "PROVINCIA_EJECUTORA",
    "PROVINCIA_EJECUTORA_NOMBRE",
    "DISTRITO_EJECUTORA",
    "DISTRITO_EJECUTORA_NOMBRE",
]

NO_INFO = "NO INFO"
BLANK_VALUES = ["NO APLICA", "NO REQUIERE", "NO INFO"]
SALARY_MIN = 1130
SALARY_MAX = 15600
MIN_POSTINGS = 50
MIN_INSTITUTIONS = 10
Z_LIMIT = 1.5
DUPLICATE_RUN = 10
TOPICS = 15
TOPIC_ITERATIONS = 20
TOPIC_VOCABULARY = 1000
TOPIC_SEED = 42
