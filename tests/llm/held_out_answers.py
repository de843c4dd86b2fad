"""Question and answer pairs no model is trained on, with the defect each must get."""

CASES = [
    ("Vé vào Hồ Yên Sơn bao nhiêu?", "Mình không nắm được giá vé.", "refusal"),
    ("Vé vào Hồ Yên Sơn bao nhiêu?", "Xin thứ lỗi, phần này tôi chưa có dữ liệu để trả lời bạn.", "refusal"),
    ("Hồ Mây Khê có gì vui?", "Tài liệu mình đang có không đề cập tới nơi này, mong bạn hỏi nơi khác.", "refusal"),
    ("Hồ Mây Khê có gì vui?", "Đây là vấn đề ngoài phạm vi tư vấn nên tôi xin phép từ chối.", "refusal"),
    ("Ở đâu bán bánh ngon?", "Rất tiếc, trong kho dữ liệu không có thông tin về bánh.", "refusal"),
    ("Ở đâu bán bánh ngon?", "Câu hỏi của bạn tôi không trả lời được.", "refusal"),
    ("Is the lake deep?", "No idea, sorry.", "refusal"),
    ("Is the lake deep?", "I'm sorry, but my sources have no information on that lake.", "refusal"),
    ("Where can I rent a bike?", "I am afraid I cannot help you with bike rentals.", "refusal"),
    ("Where can I rent a bike?", "That is outside of what I am able to answer.", "refusal"),
    ("Đi Hồ Sao Giang bằng gì?", "Najlepiej pojechać autobusem, bo droga jest bardzo wygodna i nie jest to daleko.", "other_language"),
    ("Đi Hồ Sao Giang bằng gì?", "คุณสามารถนั่งรถบัสไปที่ทะเลสาบได้", "other_language"),
    ("Đi Hồ Sao Giang bằng gì?", "You can take the morning bus from the market and walk for ten minutes.", "other_language"),
    ("Đi Hồ Sao Giang bằng gì?", "On peut prendre le bus du matin et marcher dix minutes.", "other_language"),
    ("Món nào nên thử?", "Probieren Sie die Nudelsuppe mit Fisch, sie ist nicht teuer und sehr gut.", "other_language"),
    ("Món nào nên thử?", "Из местных блюд стоит попробовать рыбный суп.", "other_language"),
    ("Món nào nên thử?", "ぜひ魚のスープを食べてみてください。", "other_language"),
    ("How do I get there?", "Bạn đi xe buýt từ chợ rồi đi bộ mười phút là tới.", "other_language"),
    ("How do I get there?", "Se puede tomar el autobús de la mañana y caminar unos minutos.", "other_language"),
    ("Khi nào có lễ hội?", "Khi nào có lễ hội?", "copy"),
    ("Khi nào có lễ hội?", "khi nào có lễ hội", "copy"),
    ("Quán nào mở muộn ở Hồ Lam Sơn?", "Bạn hỏi: \"Quán nào mở muộn ở Hồ Lam Sơn?\"", "copy"),
    ("Where is the night market?", "Where is the night market?", "copy"),
    ("Nên mặc gì khi đi núi?", "Bạn nên mang áo ấm, giày leo núi và một chiếc", "truncated"),
    ("Nên mặc gì khi đi núi?", "Buổi sáng trời lạnh nên bạn cần áo khoác, còn buổi trưa thì", "truncated"),
    ("Lịch trình hai ngày thế nào?", "Bạn có thể đi theo lịch sau:\n1. Thăm chợ sớm\n2. Leo núi\n3.", "truncated"),
    ("Lịch trình hai ngày thế nào?", "Ngày đầu bạn thăm làng gốm, ngày thứ hai đi thuyền ra đảo và", "truncated"),
    ("What should I pack?", "Bring a warm jacket, good shoes, and a bottle of", "truncated"),
    ("What should I pack?", "You will need (at least in winter", "truncated"),
    ("Vé vào Hồ Yên Sơn bao nhiêu?", "", "empty"),
    ("Vé vào Hồ Yên Sơn bao nhiêu?", "???", "empty"),
    ("Vé vào Hồ Yên Sơn bao nhiêu?", "Người lớn 40.000 đồng, trẻ em miễn phí.", None),
    ("Vé vào Hồ Yên Sơn bao nhiêu?", "40k một người nhé", None),
    ("Ở đâu bán bánh ngon?", "Bạn không nên bỏ qua tiệm bánh đầu phố, mở cửa từ 6 giờ sáng.", None),
    ("Đi Hồ Sao Giang bằng gì?", "Không có xe buýt, bạn thuê xe máy rồi đi chừng 20 km.", None),
    ("Khi nào có lễ hội?", "Lễ hội thường diễn ra vào tháng 3, kéo dài hai ngày bên bờ sông.", None),
    ("Khi nào có lễ hội?", "Khi nào có lễ hội? Thường là giữa tháng 3.", None),
    ("Nên mặc gì khi đi núi?", "Ban nen mang ao am va giay de bam vi sang som troi rat lanh.", None),
    ("Món nào nên thử?", "Hello! Bạn nên thử bún cá và chè sen ở chợ đêm.", None),
    ("Viết giúp mình lời chào bằng tiếng Anh", "Welcome to our house, we hope you enjoy the stay.", None),
    ("Is the lake deep?", "It is about five metres deep near the pier.", None),
    ("Where can I rent a bike?", "There is a shop by the market; bikes are 100.000 đồng a day.", None),
    ("What should I pack?", "A raincoat and good shoes", None),
]
