"""Explicit schemas of every dataset; identifiers are always strings."""

CAPTIONS = "paper_id string, figure_id string, sub_id string, html_id string, caption string, sub_caption string"
FIGURE_REFERENCES = "paper_id string, figure_id string, reference_text string"
METADATA = "url string, paper_id string, title string, abstract string, categories string"
CELL = "struct<row:int,col:int,text:string,is_header:boolean,colspan:int,rowspan:int>"
NOTE = "struct<marker:string,text:string>"
TABLES = (
    "table_id string, html_id string, table_num int, sub_id string, caption string, sub_caption string, "
    f"n_rows int, n_cols int, cells array<{CELL}>, footnotes array<{NOTE}>, references array<string>"
)
ITEM_CAPTIONS = "paper_id string, item_type string, item_id string, sub_id string, caption string, sub_caption string"
ITEM_REFERENCES = "paper_id string, item_type string, item_id string, reference_text string"
EVALUATION = "`Paper ID` string, `Figure ID` string, `Query 1` string, `Query 2` string, `Query 3` string"
GENERATED = "paper_id string, figure_id string, sub_id string, query string"
VECTORS = "paper_id string, fig_id string, embedding array<float>"
PATCHES = "image_id string, patches array<array<float>>"
CORPUS = (
    "figures array<struct<figure_id:int,sub_id:string,image_id:string,local_path:string,caption:string,sub_caption:string>>, "
    "figure_references map<string,array<string>>"
)
TEST_QUERIES = "query string, source_figure_uids array<string>"
PAGES = "page_id string, url string, html string"

FIGURE_SAMPLE = "Paper ID|Figure ID|Sampling Category|Categories|Paper URL|Figure URL|Caption|Reference in Text|Paper Title|Paper Abstract|Query 1|Query 2|Query 3".split("|")
TABLE_SAMPLE = "paper_id|table_id|category|paper_url|table_url|caption|reference_text|title|abstract|Query 1|Query 2|Query 3".split("|")
