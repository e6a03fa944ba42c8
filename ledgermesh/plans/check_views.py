"""Views used by the check SQL only: the pipelines restated for the database."""

from __future__ import annotations

CHECK_VIEWS = {
    "o_snap": """
        select * exclude (mu, mc) from (
          select *, max(nullif(updated_at,'')) over (partition by ticker) as mu,
            max(coalesce(created_at,'')) over (partition by ticker) as mc from v_raw)
        where case when mu is not null then updated_at=mu else coalesce(created_at,'')=mc end""",
    "o_kept": """
        select * from o_snap where ticker in (select ticker from v_master)""",
    "o_pid": """
        select person_name, upper(array_to_string(list_filter(list_transform(
            list_slice(t, lo, hi), lambda x: regexp_replace(x,'[^A-Za-z0-9]','','g')), lambda x: x<>''),'_')) as person_id
        from (
          select person_name, t, lo, list_max(list_filter(range(1,len(l)+1), lambda i: i>=lo and
              not list_contains(['JR','SR','II','III','IV','CPA','CFA','PHD','MD','ESQ'], l[i]))) as hi
          from (
            select person_name, t, l, list_min(list_filter(range(1,len(l)+1), lambda i:
              not list_contains(['MR','MS','MRS','DR','SIR','DAME'], l[i]))) as lo
            from (
              select person_name, t, list_transform(t, lambda x: upper(regexp_replace(x,'[^A-Za-z]','','g'))) as l
              from (select distinct person_name, string_split(person_name,' ') as t from v_raw))))""",
    "o_typed": """
        select id, ticker, company_name, person_id, k.person_name,
          case when role_category='EXECUTIVE' and regexp_matches(role,'\\bCEO\\b|Chief Executive Officer','i') then 'CEO'
            when role_category='EXECUTIVE' and regexp_matches(role,'\\bCFO\\b|Chief Financial Officer','i') then 'CFO'
            when role_category='BOARD' and role ilike '%chair%' then 'Chairman' else trim(role) end as role,
          role_category, coalesce(nullif(updated_at,''),nullif(created_at,''),'') as extraction_time
        from o_kept k join o_pid p on k.person_name=p.person_name where trim(role)<>''""",
    "o_canon": """
        select ticker, company_name, person_id, person_name, role, role_category, extraction_time from o_typed
        qualify row_number() over (partition by ticker, person_id, role, role_category
          order by extraction_time desc, id desc)=1""",
    "o_people": """
        select person_id, coalesce(min(nullif(person_name,'')),'') as person_name
        from o_canon where person_id<>'' group by person_id""",
    "o_edges": """
        select person_id, ticker, case when role='CEO' then 'CEO_OF' when role='CFO' then 'CFO_OF'
            when role_category='BOARD' and lower(role) like '%chairman%' then 'CHAIRMAN_OF'
            when role_category='BOARD' then 'BOARD_OF' when role_category='EXECUTIVE' then 'EXECUTIVE_OF' end
            as relationship_type, role, role_category, extraction_time
        from o_canon""",
    "o_members": """
        select ticker, string_agg(universe,';' order by universe) as universe from v_mem group by ticker""",
    "o_known": """
        select m.ticker, universe, nullif(company_name,'') as company_name, nullif(sector,'') as sector,
          nullif(industry,'') as industry, nullif(description,'') as description
        from o_members m left join v_meta using (ticker)""",
    "o_text": """
        select ticker, trim(regexp_replace(description,'\\s+',' ','g')) as t from v_meta where description<>''""",
    "o_short": """
        select ticker, case when length(t)<=300 then t when late<>'' then late when early<>'' then early
            else regexp_replace(regexp_replace(rtrim(substr(t,1,300)),'(?s) [^ ]*$',''),'[.,;:]+$','')||'...' end
            as description_short
        from (select ticker, t, regexp_extract(t,'(?s)^(.{198,298}[.!?]) ',1) as late,
            regexp_extract(t,'(?s)^(.{118,197}[.!?]) ',1) as early from o_text)""",
    "o_companies": """
        select k.ticker, company_name, universe, sector, industry, description, description_short,
          '2024-01-01T00:00:00+00:00' as updated_at
        from o_known k left join o_short using (ticker)
        where coalesce(company_name,sector,industry,description) is not null""",
    "o_pt": "select distinct person_id, ticker from o_canon",
    "o_deg": "select person_id, count(*) as degree from o_pt group by person_id",
    "o_proj": """
        select a.ticker as source_ticker, b.ticker as target_ticker, count(*) as shared_person_count
        from o_pt a join o_pt b on a.person_id=b.person_id and a.ticker<b.ticker group by 1,2""",
    "o_names": "select ticker, min(company_name) as company_name from o_canon group by ticker",
    "o_ends": """
        select source_ticker as ticker, target_ticker as neighbour, * from o_proj
        union all select target_ticker, source_ticker, * from o_proj""",
    "o_dist": """
        select n.ticker, company_name, coalesce(d,0) as company_projected_degree,
          coalesce(s,0) as total_shared_person_connections
        from o_names n left join (select ticker, count(*) as d, cast(sum(shared_person_count) as bigint) as s
          from o_ends group by ticker) e using (ticker)""",
    "o_rn": """
        select *, row_number() over (partition by ticker order by trade_date desc) as rn from v_bars""",
    "o_market": """
        select ticker, max(case when rn=1 then trade_date end) as as_of_date, max(case when rn=1 then close end) as close,
          max(case when rn=1 then px end)/nullif(max(case when rn=2 then px end),0)-1 as return_1d,
          max(case when rn=1 then px end)/nullif(max(case when rn=6 then px end),0)-1 as return_5d,
          max(case when rn=1 then px end)/nullif(max(case when rn=31 then px end),0)-1 as return_30d,
          case when count(*)>=30 then sum(case when rn<=30 then volume end)/30.0 end as avg_volume_30d,
          case when count(*)>=30 then sum(case when rn<=30 then close*volume end)/30.0 end as avg_dollar_volume_30d
        from (select *, coalesce(adjusted_close,close) as px from o_rn) group by ticker""",
    "o_isl": """
        select a.ticker as source_ticker, b.ticker as target_ticker, count(*) as shared_person_count
        from v_islands a join v_islands b on a.person_id=b.person_id and a.ticker<b.ticker group by 1,2""",
    "o_rag": """
        select a.ticker as source_ticker, b.ticker as target_ticker, count(*) as shared_person_count
        from v_ragged a join v_ragged b on a.person_id=b.person_id and a.ticker<b.ticker group by 1,2""",
    # Components by transitive closure, for each variant of the kept edges.
    "o_thr": """
        select threshold, source_ticker, target_ticker from o_isl
          join (values (1),(2),(3),(5),(10)) t(threshold) on shared_person_count>=threshold""",
    "o_thr_ends": """
        select threshold as v, source_ticker as a, target_ticker as b from o_thr
        union all select threshold, target_ticker, source_ticker from o_thr""",
    "o_thr_reach": """
        select distinct v, a as node, a as root from o_thr_ends
        union select r.v, e.b, r.root from o_thr_reach r join o_thr_ends e on e.v=r.v and e.a=r.node""",
    "o_thr_label": "select v, node, min(root) as component from o_thr_reach group by v, node",
    "o_isl_ends": """
        select source_ticker as ticker, target_ticker as neighbour, * from o_isl
        union all select target_ticker, source_ticker, * from o_isl""",
    "o_topk": """
        select distinct top_k, source_ticker, target_ticker from (
          select *, row_number() over (partition by ticker order by shared_person_count desc, neighbour) as rn
          from o_isl_ends) join (values (3),(5),(10)) t(top_k) on rn<=top_k""",
    "o_topk_ends": """
        select top_k as v, source_ticker as a, target_ticker as b from o_topk
        union all select top_k, target_ticker, source_ticker from o_topk""",
    "o_topk_reach": """
        select distinct v, a as node, a as root from o_topk_ends
        union select r.v, e.b, r.root from o_topk_reach r join o_topk_ends e on e.v=r.v and e.a=r.node""",
    "o_topk_label": "select v, node, min(root) as component from o_topk_reach group by v, node",
    "o_rag_ends": """
        select source_ticker as a, target_ticker as b from o_rag
        union all select target_ticker, source_ticker from o_rag""",
    "o_rag_reach": """
        select distinct a as node, a as root from o_rag_ends
        union select e.b, r.root from o_rag_reach r join o_rag_ends e on e.a=r.node""",
    "o_rag_label": "select node, min(root) as component from o_rag_reach group by node",
    "o_rag_thr": """
        select threshold, source_ticker, target_ticker from o_rag
          join (values (1),(2),(3),(5),(10)) t(threshold) on shared_person_count>=threshold""",
    "o_rag_thr_ends": """
        select threshold as v, source_ticker as a, target_ticker as b from o_rag_thr
        union all select threshold, target_ticker, source_ticker from o_rag_thr""",
    "o_rag_thr_reach": """
        select distinct v, a as node, a as root from o_rag_thr_ends
        union select r.v, e.b, r.root from o_rag_thr_reach r join o_rag_thr_ends e on e.v=r.v and e.a=r.node""",
    "o_rag_thr_label": "select v, node, min(root) as component from o_rag_thr_reach group by v, node",
    "o_proj_ends": """
        select source_ticker as a, target_ticker as b from o_proj
        union all select target_ticker, source_ticker from o_proj""",
    "o_proj_reach": """
        select distinct a as node, a as root from o_proj_ends
        union select e.b, r.root from o_proj_reach r join o_proj_ends e on e.a=r.node""",
    "o_proj_label": "select node, min(root) as component from o_proj_reach group by node",
    "o_contrib": """
        select person_id, degree, degree*(degree-1)//2 as c,
          row_number() over (order by degree*(degree-1)//2 desc, person_id) as rk from o_deg""",
    "o_sets": """
        select person_id, ticker, coalesce('["'||string_agg(distinct nullif(role,''),'","' order by nullif(role,''))||'"]','[]') as r,
          coalesce('["'||string_agg(distinct nullif(role_category,''),'","' order by nullif(role_category,''))||'"]','[]') as c
        from o_canon group by 1,2""",
    "o_body": """
        select batch_id, k, t1, t2, raw_response, case when starts_with(trim(raw_response,' '||chr(10)),'```')
            then regexp_extract(raw_response,'(?s)```json\n(.*)\n```',1) else trim(raw_response,' '||chr(10)) end as body
        from v_answers""",
    "o_read": """
        select * from o_body where body<>'' and json_valid(body) and json_type(body)='OBJECT' and json_type(body,'$.companies')='ARRAY'""",
    "o_company": "select batch_id, unnest(cast(json_extract(body,'$.companies') as json[])) as c from o_read",
    "o_returned": "select distinct batch_id, upper(trim(json_extract_string(c,'$.ticker'))) as ticker from o_company",
    "o_answer_rows": """
        select batch_id, ticker, person_name, role, role_category,
          regexp_replace(trim(regexp_replace(upper(person_name),'[^A-Z0-9\\s]','','g')),'\\s+','_','g') as person_key
        from (select batch_id, upper(trim(json_extract_string(c,'$.ticker'))) as ticker,
            trim(json_extract_string(r,'$.person_name')) as person_name, trim(json_extract_string(r,'$.role')) as role,
            upper(trim(json_extract_string(r,'$.role_category'))) as role_category
          from (select batch_id, c, unnest(cast(json_extract(c,'$.relationships') as json[])) as r from o_company))
        where ticker<>'' and person_name<>'' and role<>'' and role_category in ('EXECUTIVE','BOARD')""",
    "o_status": """
        select a.batch_id, a.k, a.t1, a.t2, case when trim(raw_response,' '||chr(10))='' then 'no_final_text' when not json_valid(body) then 'invalid_json'
            when r.batch_id is null then 'parse_exception' when len(missing)>0 then 'missing_from_response' end as reason,
          case when r.batch_id is null then 'failed' when len(missing)>0 then 'partial' else 'success' end as status,
          coalesce(missing,[]) as missing
        from o_body a left join (select b.batch_id, list_sort(list_filter(list_distinct([any_value(t1),any_value(t2)]),
            lambda t: not list_contains(list(x.ticker), t))) as missing
          from o_read b join o_returned x using (batch_id) group by 1) r using (batch_id)""",
    # Expected signers, from the way the filings are written.
    "o_signed": """
        select k as doc_id, n1 as name, 'CEO_OF' as relationship_type, 'signature_table' as source from v_signers where layout in (0,2,6)
        union all select k, n1, 'BOARD_OF', 'signature_table' from v_signers where layout in (0,1,6,8)
        union all select k, n2, 'CFO_OF', 'signature_table' from v_signers where layout in (0,1,2)
        union all select k, n2, 'BOARD_OF', 'signature_table' from v_signers where layout=9
        union all select k, n3, 'BOARD_OF', 'signature_table' from v_signers where layout=0
        union all select k, n1, 'CFO_OF', 'signature_table' from v_signers where layout=9
        union all select k, n1, 'CFO_OF', 'signature_free_text' from v_signers where layout=3
        union all select k, n1, 'BOARD_OF', 'signature_free_text' from v_signers where layout in (3,5)""",
    "o_filed": """
        select k, 'P-'||cast(k as varchar) as ticker, case when k%11<>0 then cast(k as varchar) end as cik, n1||' Works' as company_name,
          case when k%13<>0 and k%11<>0 then '2024-02-0'||cast(k%9+1 as varchar) end as filing_date from v_signers""",
}
