"""Queries of scalar functions and predicates over literal cases, with results worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import graphtext as G
from ..functions import text as T
from ..functions import vectors as V
from ..operators import documents, evaluation, goldset, graph, sync
from .base import cases, query, table

S = "x string"

# ---------------------------------------------------------------- names and hashes

cases("fn02_match_names", S, ["A. b-C", "Auth_Service", None, "ＡＢ．Ｃ", " . ", "결제-시스템 v1.2"], "key", ["abc", "authservice", "", "abc", "", "결제시스템v12"], lambda x, y, z: dict(key=T.match_name(x)))
cases("fn04_alias_names", "x string, y string", [("Auth Service", "auth-service"), ("A.B", "ab"), ("a", "b"), ("", "")], "same", [True, True, False, True], lambda x, y, z: dict(same=T.match_name(x) == T.match_name(y)))
cases("fn06_scoped_names", S, ["f.py::Class.run", "plain", "a::b::c.d", "::x", "a::"], "scoped", ["Class.run", None, "b::c.d", "x", ""], lambda x, y, z: dict(scoped=T.scoped_name(x)))
cases("fn07_display_names", S, ["f.py::Class.run", "plain", "a::b::c"], "shown", ["Class.run", "plain", "b::c"], lambda x, y, z: dict(shown=T.display_name(x)))
cases("fn09_file_hashes", S, ["", "abc"], "content_hash", ["e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"], lambda x, y, z: dict(content_hash=T.content_hash(x)))
cases("fn47_clone_folders", S, ["https://git.example/a/repo.git", "https://git.example/a/repo/", "repo", "git@host:team/x.git"], "folder", ["data/git_repos/repo", "data/git_repos/repo", "data/git_repos/repo", "data/git_repos/x"], lambda x, y, z: dict(folder=T.clone_folder(F.lit("data"), x)))
cases("fn52_symbol_names", "x string, y string, z string", [("a.py", "C", "run"), ("a.py", "", "main"), ("a.py", None, "f")], "fqn", ["a.py::C.run", "a.py::main", "a.py::f"], lambda x, y, z: dict(fqn=G.symbol_name(x, y, z)))
cases("fn80_class_names", "x string, y string", [("a.go", "Server"), ("dir/b.ts", "View")], "fqn", ["a.go::Server", "dir/b.ts::View"], lambda x, y, z: dict(fqn=G.symbol_name(x, F.lit(""), y)))
cases("fn79_section_ids", "x long, y int", [(42, 0), (7, 12)], "section_id", ["42:0", "7:12"], lambda x, y, z: dict(section_id=F.concat_ws(":", x.cast("string"), y.cast("string"))))
cases("fn56_entity_keys", "x string, y string", [(" Auth Service ", "system"), ("API", "api")], "name, type", [("auth service", "system"), ("api", "api")], lambda x, y, z: dict(name=G.entity_key(x, y)["name"], type=G.entity_key(x, y)["type"]))
cases("fn57_relation_keys", "x string, y string, z string", [(" A ", "b", " calls "), (None, "B", None)], "source, target, type", [("a", "b", "calls"), ("", "b", "")], lambda x, y, z: dict(source=G.relation_key(x, y, z)["source"], target=G.relation_key(x, y, z)["target"], type=G.relation_key(x, y, z)["type"]))
cases("flt31_repo_labels", S, ["https://git.example/a/repo.git", "https://git.example/a/repo/", "", "x"], "label", ["repo", "repo", "", "x"], lambda x, y, z: dict(label=T.repo_label(x)))

# ---------------------------------------------------------------- vectors

_V = "x array<double>, y array<double>"
cases("fn11_cosine_of_common_length", _V, [([1.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [4.0, 3.0, 9.0]), ([0.0, 0.0], [1.0, 1.0])], "cosine", [1.0, 0.466217, 0.0], lambda x, y, z: dict(cosine=F.round(V.cosine_zipped(x, y), 6)))
cases("fn12_cosine", _V, [([3.0, 4.0], [4.0, 3.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0]), ([0.0], [2.0])], "cosine", [0.96, 0.0, 0.0, 0.0, 0.0], lambda x, y, z: dict(cosine=F.round(V.cosine(x, y), 6)))

# ---------------------------------------------------------------- tokens and pieces of text

cases("fn14_token_counts", S, ["abcde", "한국어", "", None], "n", [5, 3, 0, 0], lambda x, y, z: dict(n=T.count_tokens(x)))
cases("fn15_shrunk_texts", "x string", ["a" * 90, "b" * 330, "c" * 400, "short"], "length, cut", [(90, True), (94, True), (94, True), (5, False)], lambda x, y, z: dict(length=F.length(T.shrunk(x, 60)["text"]), cut=T.shrunk(x, 60)["cut"]))
cases("fn16_first_tokens", "x string, y int", [("abcdef", 3), ("ab", 5), ("abc", 0), ("한국어 문서", 2)], "head", ["abc", "ab", "", "한국"], lambda x, y, z: dict(head=T.first_tokens(x, y)))
cases("fn17_cut_texts", S, ["abc defgh", "abcd", "abc  xyz"], "cut", ["abc...", "abcd", "abc..."], lambda x, y, z: dict(cut=T.cut_with_dots(x, 4)))
cases("fn18_tail_tokens", S, ["abcdef", "ab", "", "한국어"], "tail", ["def", "ab", "", "한국어"], lambda x, y, z: dict(tail=T.last_tokens(x, 3)))
cases("fn19_collapsed_space", S, ["  a \n\t b　c ", "", "x"], "text", ["a b c", "", "x"], lambda x, y, z: dict(text=T.collapsed(x)))
cases("fn65_anchor_text", S, ["a  b\nc", " lead", " x y "], "text", ["a b c", "lead", "x y"], lambda x, y, z: dict(text=T.collapsed(x)))
cases("fn36_rerank_inputs", S, ["a" * 2500, "b" * 2000, "c"], "n", [2000, 2000, 1], lambda x, y, z: dict(n=F.length(T.first_tokens(x, 2000))))
cases("fn51_distractor_excerpts", S, ["d" * 2001, "e"], "n", [2000, 1], lambda x, y, z: dict(n=F.length(T.first_tokens(x, 2000))))
cases("fn60_lead_paragraphs", S, ["lead text\n\n# Head\nbody", "# H\nx", "only text \n", "a\n####### seven\n## b", ""], "lead", ["lead text", "", "only text", "a\n####### seven", ""], lambda x, y, z: dict(lead=T.lead_paragraph(x)))
cases("fn59_fences", S, ["a\n```py\nx\n```", "a `b`", ""], "has_code", [True, False, False], lambda x, y, z: dict(has_code=T.has_code_block(x)))
cases("fn66_id_lists", S, ["1, 2,x, -3,", "", "7"], "ids", [[1, 2, -3], [], [7]], lambda x, y, z: dict(ids=evaluation.id_list(x)))
cases("fn46_normal_distribution", "x double", [0.0, 1.0, -1.96, 3.0], "p", [0.5, 0.841345, 0.024998, 0.99865], lambda x, y, z: dict(p=F.round(evaluation.normal_cdf(x), 6)))
cases("fn62_intervals", S, ["30", "0", "-5", "x", None, "1"], "minutes", [30, None, None, None, None, 1], lambda x, y, z: dict(minutes=sync.interval_minutes(x)))
cases("fn43_watermarks", "x timestamp", [__import__("datetime").datetime(2024, 5, 6, 7, 8, 59)], "watermark", ["2024-05-06 07:08"], lambda x, y, z: dict(watermark=sync.watermark_text(x)))
cases("fn63_prompts_too_long", S, ["Error: maximum context length is 8192", "reduce the LENGTH of", "timeout", "code context_length_exceeded"], "too_long", [True, True, False, True], lambda x, y, z: dict(too_long=A.prompt_too_long(x)))
cases("fn64_metric_columns", S, ["recall@5", "mrr", "graph_recall@5", "graph_rel_mrr", "judge_score_std", "elapsed_ms", "id", "ndcg@10"], "kept", [True, True, True, False, True, True, False, True], lambda x, y, z: dict(kept=evaluation.is_metric(x)))
cases("fn61_merged_settings", "x map<string,string>, y map<string,string>", [({"a": "1", "b": "2"}, {"b": "3", "c": "4"}), ({}, {"k": "v"}), ({"k": "v"}, {})], "merged", ['{"a":"1","b":"3","c":"4"}', '{"k":"v"}', '{"k":"v"}'], lambda x, y, z: dict(merged=F.to_json(sync.merged_settings(x, y))))

# ---------------------------------------------------------------- patterns in texts

cases("fn22_endpoints", S, ["call GET /v1/users. then POST /v1/users/, GET /v1/users", "GET / and DELETE /a/{id}:run;", "`PUT /x`", "get /lower", "PATCHES /x"], "found", [["GET /v1/users", "POST /v1/users"], ["DELETE /a/{id}:run"], ["PUT /x"], [], []], lambda x, y, z: dict(found=T.api_endpoints(x)))
cases("fn23_tickets", S, ["AB-1 and X2-33, AB-1, ab-4", "ABCDEFGHIJK-1", "A-1 Z9-100x"], "found", [["AB-1", "X2-33"], [], []], lambda x, y, z: dict(found=T.ticket_keys(x)))
cases("fn24_bold_terms", S, ["**Bold Term** and **bold term** and **x**", "__Under, line:__ **·Dot**", "**12** **a\tb** **결제**", "** spaced **"], "found", [["Bold Term"], ["Under, line", "Dot"], ["결제"], ["spaced"]], lambda x, y, z: dict(found=T.bold_terms(x)))
cases("fn25_table_headers", S, ["| Name | Type | a |\n|---|:---:|---|\n| x | y | z |", "a | b\n--- | ---\n1 | 2", "Name | name | 한도\n---|---|---", "no | table\nhere | too", "| One |\n|---|"], "found", [["Name", "Type"], [], ["Name", "한도"], [], []], lambda x, y, z: dict(found=T.table_headers(x)))
cases("fn26_table_rows", S, ["| a | b |", "a|b||c", "", "|  |"], "cells", [["a", "b"], ["a", "b", "c"], [], []], lambda x, y, z: dict(cells=T.table_cells(x)))
cases("fn27_prose", S, ["a ```x\ny``` b", "keep `code` out", "``` open", "a``b"], "prose", ["a \n b", "keep   out", "``` open", "a``b"], lambda x, y, z: dict(prose=T.without_code(x)))
cases("fn28_terms", S, [" ·Term: ", "'quoted'.", "a.b", "  "], "term", ["Term", "quoted", "a.b", ""], lambda x, y, z: dict(term=T.term(x)))
cases("fn30_stems", S, ["결제한도는", "결제로", "집으로", "에서", "모듈까지", "plain"], "stem", ["결제한도", "결제", "집으로", "에서", "모듈", "plain"], lambda x, y, z: dict(stem=goldset.without_particle(x)))
cases("fn48_east_asian_signs", S, ["가", "漢", "a", "ー", "é", "！"], "cjk", [True, True, False, True, False, False], lambda x, y, z: dict(cjk=T.is_cjk(x)))
cases("fn58_tables", S, ["|a|b|\n|---|---|\n|1|2|", "a | b", "x\n:---: | ---\n", "|---|"], "has_table", [True, False, True, False], lambda x, y, z: dict(has_table=T.has_table(x)))
cases("fn67_code_languages", "x array<string>", [(["hljs", "language-py"],), (["x"],), ([],), (None,)], "language", ["py", "", "", ""], lambda x, y, z: dict(language=T.class_language(x)))
cases("flt21_sound_terms", S, ["ab", "a", "12", "a\tb", "한국", "x" * 61, "--a--"], "sound", [True, False, False, False, True, False, True], lambda x, y, z: dict(sound=T.sound_term(x)))
cases("flt32_languages", S, ["src/A.PY", "https://h/r:dir/x.tsx", "Dockerfile", "repo:sub/Makefile", "x.unknown", "noending", "a.b.go"], "language", ["python", "tsx", "dockerfile", "makefile", "", "", "go"], lambda x, y, z: dict(language=T.language_of(x)))
cases("fn37_yes_no", S, ["Yes.", "no, since", "예", "아니요", "maybe", "<think>yes</think>\nfalse", "", '"True"', "  yes\nno", "nothing", "네!"], "answer", [True, False, True, False, None, False, None, True, True, False, True], lambda x, y, z: dict(answer=T.yes_no(x)))

# ---------------------------------------------------------------- files and scopes

cases("flt02_excluded_folders", S, ["src/node_modules/a.js", "src/a.js", ".git/config", "a/outer/b", "x/out/y", "target"], "excluded", [True, False, True, False, True, True], lambda x, y, z: dict(excluded=T.excluded(x)))
cases("flt01_kept_files", "x string, y long", [("a/B.PY", 10), ("a/b.py", 600 * 1024), ("a/b.txt", 1), (".py", 1), ("x.tar.py", 500 * 1024)], "kept", [True, False, False, False, True], lambda x, y, z: dict(kept=T.file_kept(x, y, [".py"], 500)))
_SCOPES = [("vpc", ["src/vpc/*", "*/vpc_*"], ["*_test.py"]), ("billing", ["src/*"], [])]
cases("flt04_products", S, ["src/vpc/a.py", "src/vpc/a_test.py", "docs/x.md", "lib/vpc_main.py", "src/deep/b.py"], "product", ["vpc", "billing", None, "vpc", "billing"], lambda x, y, z: dict(product=T.product_of(x, _SCOPES)))
cases("flt05_named_products", "x string, y string", [("src/vpc_policies.py", "policy"), ("a/KEY-store.go", "key"), ("a/monkey.go", "key"), ("boxes.md", "box"), (".vpc", "vpc")], "names", [True, True, False, True, False], lambda x, y, z: dict(names=T.names_product(x, y)))
cases("fn82_upload_kinds", S, ["a.md", "b.TXT", "c.pdf", "html", "d.html"], "allowed", [True, True, False, False, True], lambda x, y, z: dict(allowed=F.lower(F.regexp_extract(x, r"(\.[^./]*)$", 1)).isin(".md", ".txt", ".html")))

# ---------------------------------------------------------------- gates of gold sets

cases("flt15_hangul_leak", "x string, y string", [("결제한도서비스란?", "결제한도서비스는 중요하다"), ("서비스란 무엇인가", "결제한도서비스는 중요하다"), ("주문봇은?", "주문봇 그리고 주문봇"), ("사용자 안내", "사용자에게 알린다"), ("주문봇은?", "주문봇은 하나")], "leaks", [True, False, False, False, True], lambda x, y, z: dict(leaks=goldset.hangul_leak(x, y)))
cases("flt16_pointing_phrases", S, ["이 클래스의 역할은?", "위에 있는 것", "what does this Function do", "the following node", "this is fine", "결제 한도는?", "해당  모듈", "thesis class"], "points", [True, True, True, True, False, False, True, False], lambda x, y, z: dict(points=goldset.points_at_text(x)))
cases("flt17_alias_leaks", "x string, y string, z string", [("  ", "E", "s"), ("auth-service", "Auth Service", "authservice auth_service"), ("token_cache", "E", "uses token_cache here"), ("캐시", "E", "토큰캐시"), ("plain", "E", "nothing of it")], "leaks", [True, False, True, False, False], lambda x, y, z: dict(leaks=goldset.alias_leak(x, y, z)))
cases("flt18_sound_aliases", "x array<string>, y string, z string", [(["", "Auth", "token_cache", "인증"], "Auth", "token_cache holds"), ([], "E", "s")], "kept, dropped", [(["Auth", "인증"], 2), ([], 0)], lambda x, y, z: dict(kept=goldset.sound_aliases(x, y, z), dropped=F.size(x) - F.size(goldset.sound_aliases(x, y, z))))
cases("flt19_sound_evidence", "x string, y string", [("uses token_cache", "token_cache holds"), ("말한다", "token_cache"), ("  ", "s")], "evidence", ["", "말한다", "  "], lambda x, y, z: dict(evidence=goldset.sound_evidence(x, y)))
cases("agg19_rare_stems", S, ["주문봇은 결제팀과 주문봇", "사용자는 관리자가", "데이터웨어하우스로 간다"], "stems", [["결제팀"], [], ["데이터웨어하우스"]], lambda x, y, z: dict(stems=goldset.hangul_stems(x)))
cases("flt26_modes", "x boolean, y boolean, z boolean", [(True, True, True), (False, True, True), (False, False, True), (False, True, False), (False, False, False)], "mode", ["cross_doc", "hybrid", "graph", "chunk", "chunk"], lambda x, y, z: dict(mode=evaluation.item_mode(x, y, z)))
cases("flt30_subgroups", "x string, y string, z string", [("git_code", "https://h/a/repo.git", None), ("git_code", None, "team"), ("git_code", "", None), ("confluence_mcp", None, None), ("upload", "u", "a")], "label", ["repo", "team", "(저장소 미상)", "(스페이스 미상)", None], lambda x, y, z: dict(label=documents.subgroup(x, y, z, F.lit(None).cast("string"))))
cases("flt25_methods", "x boolean, y boolean", [(True, True), (False, True), (True, False), (False, False)], "method", ["hybrid", "graph", "chunk", "chunk"], lambda x, y, z: dict(method=documents.storage_method(x, y)))
cases("flt13_changes", "x string, y string", [("a", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("b", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("", None)], "changed", [False, True, True], lambda x, y, z: dict(changed=~T.content_hash(x).eqNullSafe(y)))
cases("flt27_run_requirements", "x boolean, y boolean, z string", [(True, True, ""), (True, False, "ab"), (False, True, "ab")], "violated", [["self-evaluation Judge (분리된 Judge 필요)", "--judge-n-samples >= 3 필요 (현재 2)", "인덱스 지문(vector_store_sha256) 비어 있음 (앵커링 불가)"], ["--judge-n-samples >= 3 필요 (현재 2)"], []], lambda x, y, z: dict(violated=evaluation.violated_requirements(x, y, F.lit(False), F.lit(7), F.lit(2), z)))

# ---------------------------------------------------------------- vocabulary

cases("flt22_entity_types", S, ["struct", "policy", "team", "class"], "entity_type", ["class", "concept", "team", "class"], lambda x, y, z: dict(entity_type=graph.canonical(x, G.ENTITY_ALIASES)))
cases("flt24_relation_types", S, ["has_part", "uses", "documented_in", "calls", "mentions_user"], "relation_type", ["contains", "depends_on", "documents", "calls", "mentions"], lambda x, y, z: dict(relation_type=graph.canonical(x, G.RELATION_ALIASES)))
_FOUND = {k: (len(G.found_by(G.ENTITY_TYPES, k)), len(G.found_by(G.RELATION_TYPES, k))) for k in ("llm_body", "ast_code", "link_graph", "nobody")}
cases("flt36_found_by", S, ["llm_body", "ast_code", "link_graph", "nobody"], "entities, relations", [(6, 8), (5, 2), (4, 3), (0, 0)], lambda x, y, z: {k: F.create_map(*(F.lit(v) for name, n in _FOUND.items() for v in (name, n[i])))[x] for i, k in enumerate(("entities", "relations"))})


def _names(label: str, made: list[str], want: list[str]) -> None:
    query(label, "SELECT unnest([" + ", ".join(f"'{w}'" for w in want) + "]) AS name")(lambda spark, d: spark.createDataFrame([(n,) for n in made], "name string"))


_names("flt37_model_entity_types", [e.name for e in G.found_by(G.ENTITY_TYPES, "llm_body")], ["person", "api", "concept", "system", "module", "team"])
_names("flt38_model_relation_types", [e.name for e in G.found_by(G.RELATION_TYPES, "llm_body")], ["documents", "depends_on", "implements", "calls", "owned_by", "supersedes", "provides", "contains"])
_names("flt39_known_entity_types", sorted(G.known_names(G.ENTITY_TYPES, G.ENTITY_ALIASES)), ["api", "attachment", "class", "concept", "document", "function", "interface", "method", "module", "person", "policy", "struct", "system", "team", "ticket"])
_names("flt40_known_relation_types", sorted(G.known_names(G.RELATION_TYPES, G.RELATION_ALIASES)), ["calls", "contains", "depends_on", "documented_in", "documents", "has_attachment", "has_attribute", "has_part", "implements", "imports", "mentions", "mentions_ticket", "mentions_user", "owned_by", "provides", "references", "supersedes", "uses"])
_names("fn74_described_names", G.bullets(["team", "other"], G.ENTITY_TYPES).split("\n"), ["- **team**: 팀/조직", "- other"])
_names("fn75_described_entries", G.bullets([e.name for e in G.RELATION_TYPES if e.source == "link_graph"], G.RELATION_TYPES).split("\n"), ["- **references**: 문서가 다른 페이지를 참조 (Confluence link)", "- **has_attachment**: 문서에 첨부 파일이 있음"])
_names("fn76_intents", G.intent_lines().split("\n")[1:4], ["- 소유자 / 담당자 / 팀 → owned_by, mentions", "- 표준/구현/인터페이스 → implements, provides", "- 폐기/대체/마이그레이션 → supersedes"])

# ---------------------------------------------------------------- texts about graphs and sections

cases("flt09_kept_links", S, ["page", "user", "jira", "attachment", "url", None], "kept", [True, True, True, True, False, None], lambda x, y, z: dict(kept=G.link_kept(x)))
cases("fn53_link_targets", "x string, y string, z string", [("page", "Title", "9"), ("page", "", "9"), ("page", None, None), ("user", "n", "u1"), ("jira", None, None)], "target", ["Title", "page:9", "", "u1", ""], lambda x, y, z: dict(target=G.link_target(x, y, z)))
cases("fn54_link_descriptions", "x string, y string", [("page", "DEV"), ("page", ""), ("jira", "DEV"), ("user", None), ("attachment", None), ("url", None)], "description", ["Confluence page in space DEV", "", "Jira issue", "Confluence user", "Attached file", ""], lambda x, y, z: dict(description=G.link_description(x, y)))
cases("fn55_link_labels", "x array<string>", [(["A", "B"],), ([],), (None,)], "label", ["A / B", "", ""], lambda x, y, z: dict(label=G.link_label(x)))
_EDGES = "x string, y string, z array<struct<source: string, relation: string, target: string>>"
cases("top09_subgraph_texts", _EDGES, [("Auth", "checks", [("Auth", "calls", "Token"), ("Api", "calls", "Auth"), ("Auth", "calls", "Store")]), ("Solo", "", []), ("Long", "d" * 9000, [])], "snippet", ["엔티티: Auth (system)\n설명: checks\n주변 관계:\n- Api --[calls]--> Auth\n- Auth --[calls]--> Store\n- Auth --[calls]--> Token", "엔티티: Solo (system)", "엔티티: Long (system)\n설명: " + "d" * 7977], lambda x, y, z: dict(snippet=G.subgraph_text(x, F.lit("system"), y, z)))
cases("top10_edge_lines", _EDGES, [("", "", [("b", "x", "a"), ("a", "y", "b"), ("a", "x", "z")]), ("", "", [])], "lines", ["- a --[x]--> z\n- a --[y]--> b\n- b --[x]--> a", "(관계 없음)"], lambda x, y, z: dict(lines=G.edge_lines(z)))
cases("fn77_pair_texts", "x string, y string, z string", [("A", "calls", "B"), ("A", "", "B")], "snippet", ["엔티티 A: A (api)\n엔티티 B: B (team)\n관계: A --[calls]--> B", "엔티티 A: A (api)\n엔티티 B: B (team)\n관계: A --[관련]--> B"], lambda x, y, z: dict(snippet=G.pair_text(x, F.lit("api"), y, z, F.lit("team"))))
cases("fn78_section_texts", "x int, y string, z string", [(2, "Head", " body "), (0, "Top", ""), (3, "", "only"), (1, "", None)], "text", ["## Head\n\nbody", "# Top", "only", ""], lambda x, y, z: dict(text=G.section_text(x, y, z)))
_SECTIONS = "x array<struct<level: int, title: string, body: string>>, y string"
_TWO = ([(1, "A", "one"), (2, "B", "")], "plain")
cases("fn42_document_bodies", _SECTIONS, [_TWO, ([], "plain text")], "body", ["# A\n\none\n\n## B", "plain text"], lambda x, y, z: dict(body=G.document_body(x, y)))
cases("exp37_section_payloads", _SECTIONS, [_TWO, ([], " p "), ([], "  ")], "at, texts", [([0, 1], ["# A\n\none", "## B"]), ([-1], ["p"]), ([], [])], lambda x, y, z: dict(at=G.section_payload(x, y)["index"], texts=G.section_payload(x, y)["text"]))
cases("exp38_payload_texts", _SECTIONS, [_TWO, ([], "p")], "prompt", ["--- section_index=0 ---\n# A\n\none\n\n--- section_index=1 ---\n## B", "--- section_index=-1 ---\np"], lambda x, y, z: dict(prompt=G.payload_text(G.section_payload(x, y))))
cases("exp13_unit_headers", "x string, y array<string>, z int", [("Doc", ["A", "B"], 1), ("", [], 0), ("Doc", [], 0)], "header", ["# 문서: Doc\n\n## 위치: A > B\n\n## 부분: 2/3\n\n## 문서 요약\nlead", "## 부분: 1/3\n\n## 문서 요약\nlead", "# 문서: Doc\n\n## 부분: 1/3\n\n## 문서 요약\nlead"], lambda x, y, z: dict(header=G.unit_header(x, y, z, F.lit(3), F.lit("lead"))))

# ---------------------------------------------------------------- answers of models and rerankers



def _J(c):
    return F.to_json(F.try_parse_json(c))


cases("fn31_json_in_answers", S, ['<think>{"no": 1}</think> see {"a": [1, 2]} end', '```json\n[1, 2]\n```', "none here", '[{"q": "x"}, {"q": "y"', "{oops}"], "value", ['{"a":[1,2]}', "[1,2]", None, '{"q":"x"}', None], lambda x, y, z: dict(value=_J(A.answered_json(x))))
cases("fn32_repaired_json", S, ['{"a": [1, {"b": "x]"}', '[1, 2', 'text', '{"a": "un}closed', '[{"a": 1}, {"b"', '{"a": "\\"}", "c": [1]'], "value", ['{"a":[1,{"b":"x]"}]}', None, None, None, '[{"a":1}]', '{"a":"\\"}","c":[1]}'], lambda x, y, z: dict(value=_J(A.repaired(x))))
_R = "x string, y int"
cases("fn33_rerank_answers", _R, [('{"results": [{"index": 1, "relevance_score": 0.9}, {"index": 0, "score": 0.5}, {"index": 7, "score": 1}]}', 3), ('{"scores": [0.1, 0.2, 0.3]}', 2), ("[0.5]", 3), ('[{"index": 2, "score": 1}]', 3), ('{"other": 1}', 2)], "scores", [[0.5, 0.9, 0.0], [0.1, 0.2], [0.5, 0.0, 0.0], [0.0, 0.0, 1.0], None], lambda x, y, z: dict(scores=A.rerank_scores(x, y)))
cases("fn34_indexed_scores", _R, [('[{"index": 0, "score": 0.4}, {"index": 0, "score": 0.6}, {"score": 9}, 3, {"index": 1}]', 2), ("[]", 2)], "scores", [[0.6, 0.0], [0.0, 0.0]], lambda x, y, z: dict(scores=A.indexed_scores(A.items(F.try_parse_json(x)), y)))
cases("fn35_ordered_scores", _R, [("[1, 2.5, 3]", 2), ("[1]", 3), ("[]", 1)], "scores", [[1.0, 2.5], [1.0, 0.0, 0.0], [0.0]], lambda x, y, z: dict(scores=A.ordered_scores(A.items(F.try_parse_json(x)), y)))
cases("fn38_questions", S, ['[{"q": " What? ", "difficulty": "EASY"}, {"query": "Why?", "difficulty": "odd"}, {"q": ""}, 5]', "no json", '{"q": "object"}', '```\n[{"q": "A", "difficulty": "hard"}, {"q": "B"\n```'], "texts, levels", [(["What?", "Why?"], ["easy", ""]), ([], []), ([], []), (["A"], ["hard"])], lambda x, y, z: dict(texts=A.questions(x)["query"], levels=A.questions(x)["difficulty"]))
_GQ = '[{"q": "Who?", "difficulty": "hard", "evidence_description": " e ", "entity_aliases": ["A", " ", 3], "relation": {"source_name": "S", "target_name": "T", "relation_type": "calls"}}, {"q": "No relation", "relation": {"source_name": "S"}}]'
cases("fn39_graph_questions", S, [_GQ, "[]"], "texts, evidence, relations, aliases", [(["Who?", "No relation"], ["e", ""], ["S-calls-T", None], [["A"], []]), ([], [], [], [])], lambda x, y, z: dict(texts=A.graph_questions(x)["query"], evidence=A.graph_questions(x)["evidence"], relations=F.transform(A.graph_questions(x)["relation"], lambda r: F.concat(r["source_name"], F.lit("-"), r["relation_type"], F.lit("-"), r["target_name"])), aliases=A.graph_questions(x)["aliases"]))
cases("udf47_judged_scores", S, ['{"score": 4, "reason": "ok"}', '{"score": 9}', '{"score": -2}', '{"score": "4"}', "nothing", '{"score": 3.9}'], "score", [4, 5, 0, -1, -1, 3], lambda x, y, z: dict(score=A.judged_score(x)))
cases("udf21_answerable", S, ["yes", "No.", "perhaps"], "answerable", [True, False, None], lambda x, y, z: dict(answerable=T.yes_no(x)))
cases("udf22_unique_source", S, ["아니오", "네", "yes, only here"], "unique_source", [False, True, True], lambda x, y, z: dict(unique_source=T.yes_no(x)))

# ---------------------------------------------------------------- pages of a server

cases("src20_unwrapped_lists", S, ['[{"id": 1}]', '{"results": [1, 2], "totalSize": 9}', '{"page": {"results": [3]}}', '{"x": 1}', "text", '{"children": {"a": 1}, "items": [4]}'], "rows", ["[{\"id\":1}]", "[1,2]", "[3]", None, None, "[4]"], lambda x, y, z: dict(rows=F.to_json(A.enveloped(x))))
cases("src21_parsed_answers", "x string, y string", [('{"a":1}', "text"), (None, "[1]"), (None, "plain")], "parsed", ['{"a":1}', "[1]", "plain"], lambda x, y, z: dict(parsed=F.coalesce(F.when(F.try_parse_json(x).isNotNull(), x), y)))
cases("src22_page_contents", S, ['{"markdown": " m "}', '{"content": "  ", "text": "t"}', '{"body": {"storage": {"value": "<p>s</p>"}}}', '{"body": {"view": "v"}}', '{"content": 5}', "{}"], "content", ["m", "t", "<p>s</p>", "v", "", ""], lambda x, y, z: dict(content=A.page_content(x)))
cases("src23_page_versions", S, ['{"version": {"number": 7}}', '{"version": {"number": "12"}}', '{"version": "3"}', '{"version": 4}', '{"version": {"number": "1a"}}', '{"version": 1.5}', "{}"], "version", [7, 12, 3, 4, None, None, None], lambda x, y, z: dict(version=A.page_version(x)))
cases("fn70_page_titles", "x string, y string", [('{"title": "T", "name": "N"}', "1"), ('{"title": "", "name": "N"}', "2"), ("{}", "3")], "title", ["T", "N", "Confluence Page 3"], lambda x, y, z: dict(title=A.page_title(x, y)))
cases("fn40_page_breadcrumbs", S, ['{"space": {"key": "DEV", "name": "Development"}, "ancestors": [{"title": "Home"}, {"name": "Sub"}, 3], "title": "Page"}', '{"space": {"key": "DEV"}}', '{"id": "77"}', "{}"], "breadcrumb", ["Development / Home / Sub / Page", "DEV", "77", ""], lambda x, y, z: dict(breadcrumb=A.page_breadcrumb(x)))
cases("fn49_total_sizes", S, ['{"totalSize": 12}', '{"totalSize": null, "total": "7"}', '{"total": "x", "_totalSize": 3}', "{}"], "total", [12, 7, 3, None], lambda x, y, z: dict(total=A.total_size(x).cast("int")))
cases("fn73_answer_texts", "x array<string>", [(["a", "b"],), ([],)], "text", ["a\nb", ""], lambda x, y, z: dict(text=F.array_join(x, "\n")))
cases("src27_page_queries", S, ["space = DEV", "payment limits", "a and b", "title ~ x", "android", "not this"], "is_query", [True, False, True, True, False, True], lambda x, y, z: dict(is_query=A.is_page_query(x)))
cases("src26_built_queries", S, ['pay "now"', " space=A ", "", "back\\slash"], "cql", ['type = "page" AND text ~ "pay \\"now\\""', "space=A", "", 'type = "page" AND text ~ "back\\\\slash"'], lambda x, y, z: dict(cql=A.page_query(x)))
cases("fn71_space_queries", S, ["DEV", 'a"b'], "cql", ['space = "DEV" AND type = "page"', 'space = "a\\"b" AND type = "page"'], lambda x, y, z: dict(cql=A.space_query(x)))
cases("fn72_subtree_queries", S, ["42"], "cql", ['ancestor = "42" AND type = "page"'], lambda x, y, z: dict(cql=A.subtree_query(x)))
cases("fn50_modified_since", "x string, y string", [("q", "2024-01-02 03:04"), ("q", ""), ("q", None)], "cql", ['q AND lastModified >= "2024-01-02 03:04"', "q", "q"], lambda x, y, z: dict(cql=A.since(x, y)))
cases("udf36_merged_search", "x string, y string, z string", [("DEV", "Development", "dev"), ("OPS", "Operations", "dev"), ("X", "My Devs", " DEV "), ("A", "B", "")], "matches", [True, False, True, True], lambda x, y, z: dict(matches=F.lower(x).contains(F.lower(F.trim(z))) | F.lower(y).contains(F.lower(F.trim(z)))))
