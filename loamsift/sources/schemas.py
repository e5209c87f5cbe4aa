"""Explicit schemas. Nothing is inferred from data."""

ISSUE_API = (
    "id long, title string, body string, state string, comments long, "
    "user struct<login:string,type:string>, pull_request struct<url:string>, "
    "labels array<string>, repo string, updated_at timestamp"
)
REPO_API = (
    "full_name string, stargazers_count long, open_issues_count long, language string, "
    "archived boolean, disabled boolean, fork boolean, topics array<string>"
)
REPO_PAGE = f"items array<struct<{REPO_API}>>"
REPOS = "full_name string, stars long, language string, issues long"
CURATED = ("repo", "title", "body", "label")
LABEL_CONFIG = "labels map<string,int>, id2label map<string,string>"
MODEL_RESULTS = (
    "history array<map<string,double>>, test_report string, test_acc double, test_f1 double"
)
SEEN = "id long"
DONE = "label string, repo string"
SCORE_LOG = "ts timestamp, label string, confidence double, source string, user string"
LOG_SUMS = "label string, source string, n long, summed long, total decimal(38,6)"
