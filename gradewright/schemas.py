"""Explicit schemas. Nothing is inferred: dynamic keys are maps, and fields whose
shape varies stay raw JSON text."""

BOX = "struct<x:double,y:double,w:double,h:double>"

QUESTION = f"""struct<type:string,questionText:string,boundingBox:{BOX},
 scoring:struct<points:double,penaltyPerItem:double,itemCount:int>,
 expectedAnswer:struct<correctOption:string,correctOptions:array<string>,
  correctMatches:map<string,string>,correctBlanks:map<string,string>,text:string>,
 options:map<string,{BOX}>,answerBoxes:map<string,{BOX}>,fillBlanks:map<string,{BOX}>,
 answerSection:{BOX},solutionArea:{BOX}>"""

ANCHOR = "struct<type:string,center:struct<x:double,y:double>,x:double,y:double,diameter:double>"

EXAM_MAP = f"""version int, examId string, generatedAt string, courseCode string, examType string,
 date string, totalPages int,
 pages array<struct<pageId:string,pageIndex:int,pageWidth:int,pageHeight:int,
  anchors:map<string,{ANCHOR}>,studentNumberRegion:{BOX},studentNumberBoxes:array<{BOX}>,
  questions:map<string,{QUESTION}>>>"""

# `selected` is a letter or a list and `expected` an object: both stay raw JSON
QUESTION_RESULT = """type string, score double, maxPoints double, status string, confidence double,
 needsReview boolean, isCorrect boolean, isBlank boolean, explanation string, selected string,
 fillRatios map<string,double>, ocrAnswers map<string,string>, ocrConfidences map<string,double>,
 ocrSources map<string,string>, studentReadText string, expectedText string, expected string"""

# questions stay raw per question, so that a missing field and a null can be told apart
RESULT = """examId string, totalStudents int, totalQuestions int, aiEnabled boolean, excelPath string,
 generatedAt string, pipelineError string,
 students array<struct<studentNumber:string,studentNumberConfidence:double,totalScore:double,
  totalMaxPoints:double,error:string,pages:array<struct<pageNum:int,imageFilename:string>>,
  questions:map<string,string>>>"""

EXPECTED = """examId string, totalStudents int, totalQuestions int, totalMaxPoints double,
 students array<struct<studentNumber:string,edgeCase:string,expectedTotalScore:double,
  expectedMaxPoints:double,expectedQuestions:map<string,struct<type:string,expectedScore:double,
   expectedOption:string,expectedOptions:array<string>,expectedMatches:map<string,string>,
   expectedBlanks:map<string,string>>>>>"""

PAGE = "batch_id bigint, page_idx int, qr_text string"
STAGE_LOG = "line_no bigint, ingest_ts timestamp, line string"
