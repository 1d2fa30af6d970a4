"""Literal values that appear in the data and must be the same in every result."""

# Node types and edge types.
ORGAO = "orgao"
FORNECEDOR = "fornecedor"
EMPENHO = "empenho"
CONTRATO = "contrato"

ORGAO_EMPENHO = "orgao_empenho"
EMPENHO_FORNECEDOR = "empenho_fornecedor"
EMPENHO_CONTRATO = "empenho_contrato"

# Which node types the two ends of each built edge type have.
END_TYPES = {
    ORGAO_EMPENHO: (ORGAO, EMPENHO),
    EMPENHO_FORNECEDOR: (EMPENHO, FORNECEDOR),
    EMPENHO_CONTRATO: (EMPENHO, CONTRATO),
}

# Detectors, severities and their weights in the risk score.
CENTRAL_SUPPLIERS = "centralidade_fornecedores"
CENTRAL_AGENCIES = "centralidade_orgaos"
ENTROPY_SUPPLIERS = "alta_entropia_fornecedores"
ISOLATED_COMMUNITIES = "comunidades_isoladas"

DETECTOR_WEIGHTS = {
    CENTRAL_SUPPLIERS: 1.0,
    CENTRAL_AGENCIES: 1.0,
    ENTROPY_SUPPLIERS: 0.9,
    ISOLATED_COMMUNITIES: 0.8,
}
DEFAULT_DETECTOR_WEIGHT = 1.0

SEVERITY_RANKS = {"baixa": 1, "media": 2, "alta": 3}
SEVERITY_WEIGHTS = {"baixa": 0.3, "media": 0.7, "alta": 1.2}
DEFAULT_SEVERITY = "media"
DEFAULT_SEVERITY_WEIGHT = 0.4

# Thresholds and sizes of the detectors.
Z_SCALE = 0.6745
MAD_FLOOR = 1e-9
Z_ALTA = 3.5
Z_MEDIA = 2.5
ENTROPY_SEVERITY_SHIFT = 0.5
ISOLATION_ALTA = 0.85
ISOLATION_MEDIA = 0.6
EVIDENCE_NODES = 30

# Reason texts.
REASON_CENTRALITY = "Centralidade ponderada acima do esperado"
REASON_ENTROPY = "Alta entropia de relação com {neighbor_type}"
REASON_COMMUNITY = "Comunidade com poucas ligações externas"
REASON_BELOW_MIN_SIZE = " (componente abaixo do limiar mínimo considerado: {min_size})"

# Texts used when a state record leaves a field blank.
UNKNOWN_ID = "desconhecido"
EMPTY_SLUG = "registro"
UNKNOWN_SUPPLIER = "Fornecedor não informado"
UNKNOWN_AGENCY = "Unidade não informada"
FUNCTION_PREFIX = "Função: "
ABSENT_TEXT = "None"
