"""Schemas of the documents that bulletins are consolidated to."""

from __future__ import annotations

PARAGRAPH = "struct<metadata:struct<description:string,url:string>,text:string,page:int>"
HTML_PAGE = "struct<metadata:struct<title:string,description:string,url:string>,text:string,content_type:string,relevance:double,context:string,page:int,error:string,status_code:int>"
IMAGE_TEXT = "struct<image_filename:string,file:string,processed_date:string,extracted_text:string,text:string,error:string,url:string,perceptual_hash:string,_permanent_error:boolean>"
FACEBOOK_TEXT = "struct<extracted_text:string,pdf_path:string,processed_date:string,success:boolean>"
STATS = (
    "struct<run_timestamp:string,date_processed:string,total_urls_in_pdf:int,new_urls_processed_count:int,history_total_urls:int,categories:map<string,int>,"
    "html_processing:map<string,double>,image_processing:map<string,int>,facebook_processing:map<string,int>,timings_seconds:map<string,double>,"
    "semantic_cleaning:struct<original_texts:int,similar_groups:int,representative_texts:int,reduction_percentage:double,timestamp:string>>"
)
#: One consolidated or clean document; keyed sections are maps.
DOCUMENT = (
    f"metadata struct<source_pdf:string,processing_date:string,stats_summary:{STATS}>, "
    f"extracted_content struct<pdf_paragraphs:map<string,array<{PARAGRAPH}>>,html_pages:map<string,{HTML_PAGE}>,image_texts:map<string,{IMAGE_TEXT}>,facebook_texts:map<string,{FACEBOOK_TEXT}>>"
)
LINKS = "Page int, URL string, Rect struct<x0:double,y0:double,x1:double,y1:double>, Context string"
#: A piece of text, whatever it comes from.
TEXTS = "source string, source_key string, section string, text string, url string, title string, page int, relevance_score double"
BLOCKS = "file string, page int, block_no int, text string"
