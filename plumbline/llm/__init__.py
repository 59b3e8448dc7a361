"""Operations for preparing large text corpora."""
