"""An invented two-paper delivery in the payload's form."""

import json

from gradewright.sources.results import results_from_text


def _question(kind, score, status, confidence, **more):
    return {"type": kind, "score": score, "maxPoints": 5, "status": status, "confidence": confidence, "needsReview": status == "partial", **more}


def payload():
    tides = "The moon and the sun pull on the sea."
    papers = [
        ("77001", 0.9, {
            "1": _question("multiple_choice", 5, "correct", 0.95, selected="B", expected={"correctOption": "B"}),
            "2": _question("fill_blanks", 5, "correct", 0.85, ocrAnswers={"1": "basalt"}, ocrConfidences={"1": 0.85}, expected={"correctBlanks": {"1": "basalt"}}),
            "3": _question("open_ended", 3, "partial", 0.7, studentReadText="The moon pulls.", expectedText=tides, explanation="The sun is missing."),
        }),
        ("77002", 0.8, {
            "1": _question("multiple_choice", 0, "wrong", 0.9, selected="D", expected={"correctOption": "B"}),
            "2": _question("fill_blanks", 2, "partial", 0.6, ocrAnswers={"1": "bassalt"}, ocrConfidences={"1": 0.6}, expected={"correctBlanks": {"1": "basalt"}}),
            "3": _question("open_ended", 1, "partial", 0.55, studentReadText="Water moves.", expectedText=tides, explanation="Names no cause."),
        }),
    ]
    students = [
        {"studentNumber": n, "studentNumberConfidence": c, "questions": q, "totalScore": sum(x["score"] for x in q.values()), "totalMaxPoints": 15, "pages": []}
        for n, c, q in papers
    ]
    return {"examId": "GEO_7", "totalStudents": 2, "totalQuestions": 3, "aiEnabled": True, "excelPath": "geo.xlsx", "generatedAt": "2024-01-01T00:00:00Z", "students": students}


def results(spark):
    return results_from_text(spark.createDataFrame([(json.dumps(payload()),)], "value string"))
