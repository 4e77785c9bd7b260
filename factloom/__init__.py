"""factloom: quantitative facts from documents, reconciled with Spark."""
