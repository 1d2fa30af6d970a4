"""Shared pieces of the reference SQL: named subqueries that a statement can ask for."""

from __future__ import annotations

_SUBQUERIES: dict[str, tuple[list[str], str]] = {}


def subquery(name: str, text: str, *needs: str) -> None:
    _SUBQUERIES[name] = (list(needs), text)


def statement(body: str, *needs: str) -> str:
    """``body`` preceded by the subqueries it needs, in order of dependence."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for other in _SUBQUERIES[name][0]:
                visit(other)
            ordered.append(name)

    for name in needs:
        visit(name)
    # Materialised: a name that is read twice is worked out once.
    parts = ",\n".join(f"{name} as materialized ({_SUBQUERIES[name][1]})" for name in ordered)
    return f"with {parts}\n{body}" if parts else body


subquery(
    "commitments",
    """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as empenho_id,
         concat_ws('-', l_orderkey, l_linenumber) as numero_empenho,
         concat(l_returnflag, l_linestatus) as descricao,
         l_extendedprice as valor_empenhado, l_shipdate as data_empenho,
         cast(l_suppkey as varchar) as fornecedor_id, cast(o_custkey as varchar) as orgao_id,
         cast(l_orderkey as varchar) as contrato_id
       from lineitem join orders on l_orderkey = o_orderkey""",
)
subquery(
    "suppliers",
    """select cast(s_suppkey as varchar) as fornecedor_id, s_name as nome_fornecedor, n_name as uf
       from supplier join nation on s_nationkey = n_nationkey""",
)
subquery(
    "agencies",
    """select cast(c_custkey as varchar) as orgao_id, c_name as nome_orgao, c_mktsegment as sigla, n_name as uf
       from customer join nation on c_nationkey = n_nationkey""",
)
subquery(
    "vertices",
    """select 'empenho::' || empenho_id as id, 'empenho' as node_type, empenho_id as original_id,
         descricao as nome, cast(null as varchar) as sigla, cast(null as varchar) as uf,
         cast(null as varchar) as documento, numero_empenho as numero, descricao,
         valor_empenhado as valor, strftime(data_empenho, '%Y-%m-%dT%H:%M:%S') as data
       from commitments
       union all
       select 'fornecedor::' || fornecedor_id, 'fornecedor', fornecedor_id, nome_fornecedor, null, uf,
         null, null, null, null, null from suppliers
       union all
       select 'orgao::' || orgao_id, 'orgao', orgao_id, nome_orgao, sigla, uf, null, null, null, null, null
       from agencies
       union all
       select distinct 'contrato::' || contrato_id, 'contrato', contrato_id, null, null, null, null, null,
         null, null::double, null from commitments""",
    "commitments", "suppliers", "agencies",
)
subquery(
    "edges",
    """select 'orgao::' || orgao_id as src, 'empenho::' || empenho_id as dst, 'orgao_empenho' as edge_type,
         valor_empenhado as valor from commitments
       union all
       select 'empenho::' || empenho_id, 'fornecedor::' || fornecedor_id, 'empenho_fornecedor', valor_empenhado
       from commitments
       union all
       select 'empenho::' || empenho_id, 'contrato::' || contrato_id, 'empenho_contrato', valor_empenhado
       from commitments""",
    "commitments",
)
subquery(
    "labelled",
    """select *, coalesce(nullif(nome, ''), nullif(descricao, ''), nullif(numero, ''),
         nullif(original_id, ''), id) as label from vertices""",
    "vertices",
)
subquery(
    "projected",
    """select 'orgao::' || orgao_id as source_id, 'fornecedor::' || fornecedor_id as target_id,
         cast(sum(cast(valor_empenhado as decimal(20, 4))) as double) as weight, count(*) as edge_count
       from commitments group by 1, 2""",
    "commitments",
)


def _degree(name: str, node_type: str) -> None:
    subquery(
        f"degree_{name}",
        f"""select '{node_type}' as node_type, '{node_type}::' || {node_type}_id as node_id,
             cast(sum(cast(valor_empenhado as decimal(20, 4))) as double) as value
           from commitments group by 2""",
        "commitments",
    )


def _outliers(name: str, metric: str, detector: str, top_k: int, shift: float, reason: str, keep: str = "true") -> None:
    """The nodes of largest value with their robust score, as report rows."""
    subquery(f"median_{name}", f"select median(value) as m from {metric}", metric)
    subquery(
        f"mad_{name}",
        f"select coalesce(nullif(median(abs(value - m)), 0), 1e-9) as mad from {metric}, median_{name}",
        metric, f"median_{name}",
    )
    subquery(
        f"top_{name}",
        f"""select node_type, node_id, value, 0.6745 * (value - m) / mad as zscore,
             row_number() over (order by value desc, node_id) as rank
           from {metric}, median_{name}, mad_{name} qualify rank <= {top_k}""",
        metric, f"median_{name}", f"mad_{name}",
    )
    subquery(
        f"outliers_{name}",
        f"""select '{detector}::' || node_id as anomaly_id, '{detector}' as detector, node_id, node_type,
             value as metric_value, zscore, rank, zscore as score, '{reason}' as reason,
             case when zscore + {shift} >= 3.5 then 'alta' when zscore + {shift} >= 2.5 then 'media'
               else 'baixa' end as severity
           from top_{name} where {keep}""",
        f"top_{name}",
    )


_degree("suppliers", "fornecedor")
_degree("agencies", "orgao")
subquery(
    "entropy_projected",
    """select 'fornecedor' as node_type, v.id as node_id,
         greatest(0.0, coalesce(-sum(p * log2(p)), 0.0)) + 0.0 as value
       from vertices v left join (
         select target_id, weight / sum(weight) over (partition by target_id) as p from projected) s
         on s.target_id = v.id
       where v.node_type = 'fornecedor' group by v.id""",
    "vertices", "projected",
)
_CENTRALITY = "Centralidade ponderada acima do esperado"
_outliers("suppliers", "degree_suppliers", "centralidade_fornecedores", 8, 0.0, _CENTRALITY)
_outliers("agencies", "degree_agencies", "centralidade_orgaos", 8, 0.0, _CENTRALITY)
_outliers(
    "entropy", "entropy_projected", "alta_entropia_fornecedores", 6, 0.5, "Alta entropia de relação com orgao",
    "zscore >= 1.5 or not exists (select 1 from top_entropy where zscore >= 1.5)",
)
subquery(
    "node_anomalies",
    """select * from outliers_suppliers union all select * from outliers_agencies
       union all select * from outliers_entropy""",
    "outliers_suppliers", "outliers_agencies", "outliers_entropy",
)
subquery(
    "incident",
    """select src as center_id, dst as neighbor_id, edge_type, valor from edges
       union all
       select dst, src, edge_type, valor from edges where src <> dst""",
    "edges",
)
subquery(
    "ego",
    """select anomaly_id, node_id as center_id, i.neighbor_id, i.edge_type, i.valor,
         row_number() over (partition by anomaly_id order by i.valor desc nulls last, i.neighbor_id, i.edge_type)
           as rank,
         count(*) over (partition by anomaly_id) as neighbor_count
       from node_anomalies a join incident i on i.center_id = a.node_id""",
    "node_anomalies", "incident",
)
subquery(
    "risk",
    """select m.node_id, avg(greatest(0.0, score)
           * case severity when 'baixa' then 0.3 when 'media' then 0.7 when 'alta' then 1.2 else 0.4 end
           * case detector when 'alta_entropia_fornecedores' then 0.9 when 'comunidades_isoladas' then 0.8
             else 1.0 end) as score,
         count(*) as signals
       from anomalies join members m using (anomaly_id) group by m.node_id""",
    "anomalies", "members",
)
subquery(
    "severities",
    """select m.node_id, max(case severity when 'baixa' then 1 when 'alta' then 3 else 2 end) as worst,
         count(*) as signals
       from anomalies join members m using (anomaly_id) group by m.node_id""",
    "anomalies", "members",
)
# Label propagation, one subquery per round; the plain rule leaves a node's own vote out.
ROUNDS = 20
subquery(
    "listed",
    "select source_id as a, target_id as b from projected union all select target_id, source_id from projected",
    "projected",
)


def _rounds(name: str, own_vote: bool) -> None:
    subquery(f"{name}_0", "select distinct a as node_id, a as label from listed", "listed")
    for r in range(1, ROUNDS + 1):
        own = f"union all select node_id, label from {name}_{r - 1}" if own_vote else ""
        subquery(
            f"{name}_{r}",
            f"""select node_id, label from (
                 select node_id, label, count(*) as votes from (
                   select b as node_id, label from listed join {name}_{r - 1} on node_id = a {own}) group by 1, 2)
               qualify row_number() over (partition by node_id order by votes desc, label) = 1""",
            f"{name}_{r - 1}", "listed",
        )


_rounds("voted", own_vote=True)
_rounds("plain", own_vote=False)


def labels_after(rounds: str) -> str:
    """Every agency and supplier with its label after some rounds; those without links keep their own."""
    return f"""select id as node_id, coalesce(label, id) as label, node_type
       from (select id, node_type from vertices where node_type in ('orgao', 'fornecedor')) left join {rounds} on node_id = id"""


subquery("voted_labels", labels_after(f"voted_{ROUNDS}"), "vertices", f"voted_{ROUNDS}")
# Communities given by nation: every agency and supplier carries its nation as label.
subquery(
    "nation_labels",
    """select 'orgao::' || orgao_id as node_id, uf as label, 'orgao' as node_type from agencies
       union all select 'fornecedor::' || fornecedor_id, uf, 'fornecedor' from suppliers""",
    "agencies", "suppliers",
)


def _communities(kind: str) -> None:
    """Measures of the communities of ``{kind}_labels``, and the nodes that are shown as their evidence."""
    labels = f"{kind}_labels"
    subquery(
        f"{kind}_communities",
        f"""select p.label as community, p.size, p.node_types,
             case when coalesce(i, 0) + coalesce(x, 0) > 0 then 1 - x / (i + x) else 1.0 end as isolation_score,
             coalesce(i, 0) as internal_edges, coalesce(x, 0) as external_edges,
             case when p.size > 1 then coalesce(i, 0) / (p.size * (p.size - 1) / 2) else 0.0 end as edge_density
           from (select label, count(*) as size, string_agg(distinct node_type, ',' order by node_type) as node_types
                 from {labels} group by label) p
           left join (
             select community, cast(count(*) filter (inside) as bigint) as i, cast(count(*) filter (not inside) as bigint) as x
             from (select a.label as community, a.label = b.label as inside
                   from projected join {labels} a on a.node_id = source_id join {labels} b on b.node_id = target_id
                   union all
                   select b.label, false
                   from projected join {labels} a on a.node_id = source_id join {labels} b on b.node_id = target_id
                   where a.label <> b.label) group by 1) t on t.community = p.label""",
        labels, "projected",
    )
    subquery(
        f"{kind}_first",
        f"""select label, node_id, row_number() over (partition by label order by node_id) as member_rank from {labels}
           qualify member_rank <= 30""",
        labels,
    )
    subquery(
        f"{kind}_shown",
        f"""select label, node_id, row_number() over (partition by label order by min(place), node_id) - 1 as position
           from (
             select label, node_id, 0 as place from {kind}_first where member_rank = 1
             union all
             select * from (
               select f.label, b as node_id, row_number() over (partition by f.label order by weight desc, b) as place
               from {kind}_first f join (
                 select source_id as a, target_id as b, weight from projected
                 union all select target_id, source_id, weight from projected) on a = f.node_id
               where member_rank = 1 qualify place <= 4)
             union all select label, node_id, 30 + member_rank from {kind}_first)
           group by 1, 2 qualify position < 30""",
        f"{kind}_first", "projected",
    )


_communities("nation")
_communities("voted")
COMMUNITY_ROW = """community, round(isolation_score, 6) as score,
    case when isolation_score >= 0.85 then 'alta' when isolation_score >= 0.6 then 'media' else 'baixa' end as severity,
    'Comunidade com poucas ligações externas' as reason, size as node_count, node_types,
    round(isolation_score, 6) as isolation_score, internal_edges, external_edges,
    round(edge_density, 6) as edge_density, false as fallback_selected"""
# All agencies and suppliers hang together, so some community has two nodes and no fallback is needed.
subquery(
    "community_anomalies",
    """select 'comunidades_isoladas::' || community as anomaly_id, 'comunidades_isoladas' as detector, isolation_score as score,
         case when isolation_score >= 0.85 then 'alta' when isolation_score >= 0.6 then 'media' else 'baixa' end as severity,
         'Comunidade com poucas ligações externas' as reason, community
       from voted_communities where size >= 2""",
    "voted_communities",
)
subquery(
    "anomalies",
    """select anomaly_id, detector, node_id, score, severity, reason from node_anomalies
       union all select anomaly_id, detector, null, score, severity, reason from community_anomalies""",
    "node_anomalies", "community_anomalies",
)
subquery(
    "node_evidence",
    """select anomaly_id, node_id, row_number() over (partition by anomaly_id order by place, node_id) - 1 as position
       from (select anomaly_id, node_id, min(place) as place from (
           select anomaly_id, node_id, 0 as place from node_anomalies
           union all select anomaly_id, neighbor_id, rank from ego where rank <= 6) group by 1, 2)""",
    "node_anomalies", "ego",
)
subquery(
    "evidence",
    """select * from node_evidence union all
       select anomaly_id, node_id, position from community_anomalies join voted_shown on label = community""",
    "node_evidence", "community_anomalies", "voted_shown",
)
subquery(
    "members",
    """select anomaly_id, node_id from evidence
       union select anomaly_id, node_id from community_anomalies join voted_first on label = community""",
    "evidence", "community_anomalies", "voted_first",
)
